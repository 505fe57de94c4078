"""Table functions for SQL: elements of pages by LATERAL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from eventmill.operators.tree import ROW, TAG, TreeBatch
from eventmill.schema import NODE

_INTS = ["node_id", "end_id", "parent_id", "sib_ord", "depth"]
_RUNS = ["run_lo", "run_n"]
#: White space as the column functions see it.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

ELEMENTS = T.StructType(
    [NODE[c] for c in [*_INTS, "tag", "attrs", *_RUNS]]
    + [T.StructField("classes", T.ArrayType(T.StringType()))]
)


class PageElements:
    """Every element of one page, in the columns of ``shape.elements``.

    Pages that cannot be read, null ones among them, give no rows.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(html.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"page_elements reads text, not {html.dataType.simpleString()}")
        return AnalyzeResult(ELEMENTS)

    def eval(self, html: str):
        tree = TreeBatch()
        tree.add(html)
        ints, runs = [ROW.index(c) for c in _INTS], [ROW.index(c) for c in _RUNS]
        for i, row in enumerate(tree.rows):
            lo, hi = tree.attr_ends[i], tree.attr_ends[i + 1]
            attrs = dict(zip(tree.attr_keys[lo:hi], tree.attr_values[lo:hi]))
            classes = [c for c in _BLANKS.split(attrs.get("class") or "") if c]
            yield (*[row[k] for k in ints], row[TAG], attrs, *[row[k] for k in runs], classes)


def register_tables(spark: SparkSession) -> None:
    """Make ``page_elements(html)`` known to the session's SQL."""
    spark.udtf.register("page_elements", F.udtf(PageElements))
