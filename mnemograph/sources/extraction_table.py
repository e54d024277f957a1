"""Extraction as a table function: facts of a text as rows, in SQL after LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from mnemograph.schema import EXTRACTED_FACT
from mnemograph.sources.models import ExternalExtractor, LocalExtractor

#: A place in the answer, from 0, and the fact.
ROW = T.StructType([T.StructField("pos", T.LongType(), False), *EXTRACTED_FACT.fields])


def register_extraction(spark: SparkSession, make: Callable[[], LocalExtractor | ExternalExtractor], name: str = "extract_facts") -> None:
    """Make ``name(text)`` a table function: ``SELECT t.id, f.* FROM turns t, LATERAL extract_facts(t.text) f``.

    ``make`` is called once in each task. A text that is null, one whose extraction
    fails and an answer that is not exactly one array of facts give no rows; an
    argument that is no string is an error of the plan.
    """

    class Extraction:
        def __init__(self) -> None:
            self._model = None

        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType | T.NullType):
                raise ValueError(f"the text to extract from is a string, not {text.dataType.simpleString()}")
            return AnalyzeResult(schema=ROW)

        def eval(self, text: str) -> Iterator[tuple]:
            if text is None:
                return
            if self._model is None:
                self._model = make()
            try:
                facts = self._model.extract(text)
            except Exception:  # noqa: BLE001  whatever a client raises
                return
            for pos, f in enumerate(facts):
                yield (pos, *(f[n] for n in EXTRACTED_FACT.names))

    spark.udtf.register(name, udtf(Extraction))
