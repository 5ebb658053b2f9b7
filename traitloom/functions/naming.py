"""Names, codes and lookups of specimen records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id columns in the order they are looked for.
ID_COLUMNS = ("gbifID", "id", "coreid")
# Columns that may hold a herbarium code, in order of preference.
HERBARIUM_COLUMNS = ("institutionCode", "institutionID", "ownerInstitutionCode", "collectionCode", "publisher", "occurrenceID")
# Institutions whose code is given by name.
HERBARIUM_OVERRIDES = {"UBC Herbarium": "UBC", "Naturalis Biodiversity Center": "L", "Forest Herbarium Ibadan (FHI)": "FHI"}
# Derived codes that are rewritten.
HERBARIUM_REWRITES = {
    "Qarshi-Botanical-Garden,-Qarshi-Industries-Pvt.-Ltd,-Pakistan": "Qarshi-Botanical-Garden",
    "12650": "SDSU",
    "322": "SDSU",
    "GC-University,-Lahore": "GC-University-Lahore",
    "Institute-of-Biology-of-Komi-Scientific-Centre-of-the-Ural-Branch-of-the-Russian-Academy-of-Sciences": "Komi-Scientific-Centre",
}
# Month names and conservation status codes of download requests.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
CONSERVATION = {
    "Extinct (EX)": "EX", "Extinct in the Wild (EW)": "EW", "Critically Endangered (CR)": "CR", "Endangered (EN)": "EN", "Vulnerable (VU)": "VU",
    "Near Threatened (NT)": "NT", "Least Concern (LC)": "LC", "Data Deficient (DD)": "DD", "Not Evaluated (NE)": "NE",
}


def resolve_id(df: DataFrame, order=ID_COLUMNS, name: str = "id") -> DataFrame:
    """Rename the first id column present to ``name``."""
    for column in order:
        if column in df.columns:
            return df.withColumnRenamed(column, name)
    raise ValueError(f"none of {order} is a column")


def herbarium_code(columns: list[str]) -> Column:
    """Code of the holding herbarium, from those of the candidate columns that exist.

    The first candidate of at most eight characters counts, else the publisher
    with hyphens for spaces, else ERROR; some institutions override it.
    """
    there = [c for c in HERBARIUM_COLUMNS if c in columns]
    short = [F.when(F.length(c) <= 8, F.col(c)) for c in there]
    rest = [F.replace("publisher", F.lit(" "), F.lit("-"))] if "publisher" in there else []
    code = F.coalesce(*short, *rest, F.lit("ERROR"))
    if "occurrenceID" in there:
        code = F.when(F.contains("occurrenceID", F.lit("id.luomus.fi")), "FinBIF").otherwise(code)
    if "institutionID" in there:
        for institution, fixed in HERBARIUM_OVERRIDES.items():
            code = F.when(F.col("institutionID") == institution, fixed).otherwise(code)
    rewrites = F.create_map(*[F.lit(x) for pair in HERBARIUM_REWRITES.items() for x in pair])
    return F.get(F.transform(F.array(code), lambda c: F.coalesce(F.element_at(rewrites, c), c)), F.lit(0))  # the code is named once


def legal(text: Column) -> Column:
    """Only letters, digits, ``_`` and ``-``."""
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "")


def first_word(text: Column) -> Column:
    return F.get(F.split(text, " "), F.lit(0))


def specimen_names(df: DataFrame, on_null: str = "blank") -> DataFrame:
    """Add herb, family_name, genus_name, species_name, fullname, filename_image and filename_image_jpg.

    ``on_null='drop'`` leaves out rows without family or genus; ``'blank'``
    blanks all parts of their names.
    """
    if on_null not in ("blank", "drop"):
        raise ValueError("on_null is 'blank' or 'drop'")
    known = F.col("family").isNotNull() & F.col("genus").isNotNull()
    if on_null == "drop":
        df = df.where(known)
    part = lambda c: F.when(known, c).otherwise(F.lit(""))
    out = df.withColumns(
        {
            "herb": legal(herbarium_code(df.columns)),
            "family_name": part(legal(first_word(F.col("family")))),
            "genus_name": part(legal(first_word(F.col("genus")))),
            "species_name": part(F.coalesce(legal(first_word(F.col("specificEpithet"))), F.lit(""))),
        }
    )
    out = out.withColumn("fullname", F.concat_ws("_", "family_name", "genus_name", "species_name"))
    out = out.withColumn("filename_image", F.concat_ws("_", "herb", "id", "fullname"))
    return out.withColumn("filename_image_jpg", F.concat("filename_image", F.lit(".jpg")))


def taxon_key(family: str = "family", genus: str = "genus", epithet: str = "specificEpithet") -> Column:
    """``family_genus_epithet``; a missing epithet is empty."""
    return F.concat(family, F.lit("_"), genus, F.lit("_"), F.coalesce(epithet, F.lit("")))


def name_parts(name: Column) -> dict[str, Column]:
    """Parts of a file name ``herb_id_family_genus_species``; all null with under four parts."""
    parts = F.split(name, "_")
    enough = F.size(parts) >= 4
    out = {key: F.when(enough, F.get(parts, F.lit(i))) for i, key in enumerate(("herb", "id", "family", "genus", "species"))}
    out["fullname"] = F.when(enough, F.array_join(F.slice(parts, 3, 3), "_"))
    out["class"] = F.when(enough, F.array_join(F.slice(parts, 3, 2), "_"))
    return out


def megapixels(height: Column, width: Column, digits: int | None = None) -> Column:
    exact = height.cast("double") * width / F.lit(1e6)  # doubles, as the pixels of large images exceed an int
    return exact if digits is None else F.round(exact, digits)


def resized(width: Column, height: Column, side: int = 5000) -> tuple[Column, Column]:
    """Width and height with the longer side at ``side`` and the aspect kept; halves go to even."""
    other = F.bround(F.lit(float(side)) / (F.greatest(width, height) / F.least(width, height))).cast("int")
    return F.when(height > width, other).otherwise(F.lit(side)), F.when(height > width, F.lit(side)).otherwise(other)


def url_host(url: Column) -> Column:
    """Third part between slashes; ``invalid_url`` without one, null for null."""
    return F.when(url.isNotNull(), F.coalesce(F.get(F.split(url, "/"), F.lit(2)), F.lit("invalid_url")))


def component_name(file: Column, code: Column, corners: list[Column]) -> Column:
    return F.concat_ws("__", file, code, F.concat_ws("-", *corners))


def component_parts(name: Column) -> dict[str, Column]:
    """File, code and corners of a component name; corners are null where they are no numbers."""
    parts = F.split(name, "__")
    corners = F.split(F.get(parts, F.lit(2)), "-")
    out = {"file": F.get(parts, F.lit(0)), "code": F.get(parts, F.lit(1))}
    return out | {key: F.get(corners, F.lit(i)).try_cast("int") for i, key in enumerate(("x1", "y1", "x2", "y2"))}


def hex_colour(text: Column) -> dict[str, Column]:
    """Red, green and blue of ``#rrggbb``."""
    digits = F.replace(text, F.lit("#"), F.lit(""))
    return {key: F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for key, i in (("r", 1), ("g", 3), ("b", 5))}


def upright(height: Column, width: Column) -> dict[str, Column]:
    """Landscape sheets are turned: height, width and whether they were."""
    return {"height": F.greatest(height, width), "width": F.least(height, width), "rotated": height < width}


def wished_taxa(wishes: DataFrame, text: str = "taxon") -> DataFrame:
    """One row (genus, species) per candidate of a wish list entry.

    Entries with commas hold several candidates, of which only those longer
    than five characters count; a candidate has exactly two parts.
    """
    several = F.contains(text, F.lit(", "))
    out = wishes.withColumn("candidate", F.explode(F.split(text, ", "))).where(~several | (F.length("candidate") > 5))
    parts = F.split("candidate", "[_ ]")
    return out.where(F.size(parts) == 2).withColumns({"wish_genus": F.get(parts, F.lit(0)), "wish_species": F.get(parts, F.lit(1))})


def month_number(name: Column) -> Column:
    return F.coalesce(*[F.when(name == m, i + 1) for i, m in enumerate(MONTHS)])


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))
