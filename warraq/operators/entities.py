"""Named entities: the slot for a recogniser, and its default stand-in by lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.functions import text as t

#: A recogniser: text column -> array of struct(entity_group, word).
Recogniser = Callable[[Column], Column]
# The groups of spans and the columns they go to.
GROUPS = {"PER": "persons", "ORG": "organizations", "LOC": "locations", "MISC": "misc"}


def listed(names: Mapping[str, Sequence[str]]) -> Recogniser:
    """The default stand-in for a model: the listed names of each group that stand in the text as whole words. Deterministic, and no model."""

    def spans(text: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{t.WORD}]+", " "), F.lit(" "))
        every = F.array(*[F.struct(F.lit(g).alias("entity_group"), F.lit(n).alias("word")) for g, ns in names.items() for n in ns])
        return F.filter(every, lambda e: F.contains(padded, F.concat(F.lit(" "), e["word"], F.lit(" "))))

    return spans


def with_entities(df: DataFrame, text: Column, recogniser: Recogniser) -> DataFrame:
    """`df` with the entity columns made from the recogniser's spans."""
    d = df.withColumn("_spans", recogniser(text))
    return d.withColumns({c: t.routed(F.col("_spans"), g) for g, c in GROUPS.items()}).drop("_spans")
