"""Case forms and lemmas of words, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cloakwork.sources.dictionaries import dictionaries

from . import masking
from . import morphology as M

#: What a word may be turned into.
KINDS: dict[str, Callable[[str], list[str]]] = {
    "first_name": M.first_name_forms,
    "surname": M.surname_lemmas,
    "place": M.place_forms,
    "patronymic": lambda t: [M.patronymic_base(t)] if M.is_patronymic_like(t) else [],
    "surname_like": lambda t: [t] if M.surname_like(t) else [],
    "identity": lambda t: [masking.canonical_name(t, dictionaries())],
}


def word_forms(words: DataFrame, kind: str, column: str = "word") -> DataFrame:
    """words with `forms`, of a kind of KINDS; a null word has none."""
    schema = StructType([*words.drop("forms").schema.fields, StructField("forms", ArrayType(StringType()))])
    source = words.drop("forms")
    at = source.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [KINDS[kind](w) if w else [] for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.list_(pa.string()))], names=[*batch.schema.names, "forms"])

    return source.mapInArrow(run, schema)
