"""Manifests and lockfiles as table functions of SQL: LATERAL manifest_declarations(text), lock_packages(text) and so on."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from provenio.sources.documents import DEPENDENCY, parse_lock, parse_manifest

#: Function -> (parser, field of its result, schema of a row).
_DEPENDENCY = ", ".join(field.replace(": ", " ") for field in DEPENDENCY.split(", "))
FUNCTIONS = {
    "manifest_declarations": (parse_manifest, "declarations", _DEPENDENCY),
    "workspace_templates": (parse_manifest, "templates", _DEPENDENCY),
    "manifest_diagnostics": (parse_manifest, "diagnostics", "code string, message string"),
    "lock_packages": (parse_lock, "packages", "node int, name string, version string, source string"),
    "lock_edges": (parse_lock, "edges", "src int, dst int"),
}


def _table_function(parse, field: str, schema: StructType):
    class Rows:
        """One text in, the rows of one of its lists out; a text that does not parse has none."""

        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, StringType):
                raise ValueError(f"a text is wanted, not {text.dataType.simpleString()}")
            return AnalyzeResult(schema)

        def eval(self, text: str | None):
            for row in parse(text)[field]:
                yield tuple(row[name] for name in schema.names)

    return Rows


def register_table_functions(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, (parse, field, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(_table_function(parse, field, StructType.fromDDL(schema))))
