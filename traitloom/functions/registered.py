"""Functions under SQL names: row functions that return structs, and a table function for label texts.

The row functions are SQL-defined, so Catalyst inlines them like any other
expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name, parameters, result type and body of every row function.
ROW_FUNCTIONS = (
    (
        "pixel_corners", "xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE, width INT, height INT", "STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>",
        "named_struct('x1', CAST((xc - w / 2) * width AS BIGINT), 'y1', CAST((yc - h / 2) * height AS BIGINT), 'x2', CAST((xc + w / 2) * width AS BIGINT), 'y2', CAST((yc + h / 2) * height AS BIGINT))",
    ),
    (
        "box_overlap", "a STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>, b STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>", "STRUCT<shared: BIGINT, joined: BIGINT>",
        """named_struct('shared', greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0),
           'joined', (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))""",
    ),
    (
        "file_name_parts", "name STRING", "STRUCT<herb: STRING, id: STRING, family: STRING, genus: STRING, species: STRING, fullname: STRING>",
        """CASE WHEN size(split(name, '_')) >= 4 THEN named_struct('herb', get(split(name, '_'), 0), 'id', get(split(name, '_'), 1), 'family', get(split(name, '_'), 2),
           'genus', get(split(name, '_'), 3), 'species', get(split(name, '_'), 4), 'fullname', array_join(slice(split(name, '_'), 3, 3), '_')) END""",
    ),
    (
        "hex_to_rgb", "colour STRING", "STRUCT<r: INT, g: INT, b: INT>",
        "named_struct('r', CAST(conv(substr(replace(colour, '#', ''), 1, 2), 16, 10) AS INT), 'g', CAST(conv(substr(replace(colour, '#', ''), 3, 2), 16, 10) AS INT), 'b', CAST(conv(substr(replace(colour, '#', ''), 5, 2), 16, 10) AS INT))",
    ),
)


@udtf(returnType="line: int, cls: int, xc: double, yc: double, w: double, h: double, score: double, problem: string")
class ParseYolo:
    """Lines ``cls xc yc w h [score]`` of a label text as rows.

    ``line`` counts from 0.  Blank lines give no row; a line that is no label
    gives its number and what is wrong: ``fields`` (fewer than five or more
    than six) or ``number``.  Null and empty texts give no row.
    """

    def eval(self, text: str):
        for at, line in enumerate((text or "").split("\n")):
            fields = line.split()
            if not fields:
                continue
            if not 5 <= len(fields) <= 6:
                yield at, None, None, None, None, None, None, "fields"
                continue
            try:
                cls, numbers = int(fields[0]), [float(x) for x in fields[1:]]
            except ValueError:
                yield at, None, None, None, None, None, None, "number"
                continue
            yield (at, cls, *numbers[:4], numbers[4] if len(numbers) > 4 else None, None)


def register(spark: SparkSession) -> list[str]:
    """Give the session all functions of this module as temporary ones, and name them."""
    for name, parameters, result, body in ROW_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("parse_yolo", ParseYolo)
    return [f[0] for f in ROW_FUNCTIONS] + ["parse_yolo"]
