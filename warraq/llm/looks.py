"""The look-alike table: the published confusables data, as the ICU library among Spark's own jars holds it.

The table is not stored here. The driver asks ICU once per application for the prototype of every assigned character, writes
the answer (about 10,000 entries, a size that Unicode fixes) to the shared folder and has Spark ship it to every worker, also
to those that start later.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from functools import cache

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from warraq.runtime import shared_dir

NAME = "warraq-looks.json"
#: Characters per question to ICU.
_AT_ONCE = 20_000

_state: dict[str, object] = {}


def decomposed(c: str) -> str:
    return unicodedata.normalize("NFKD", c)


def build(spark: SparkSession) -> dict[str, str]:
    """Character -> prototype, of all assigned characters whose prototype is not the character itself; '' for those without a look."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    every = [chr(i) for i in range(0x21, 0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Co", "Cs")]
    every = [c for c in every if decomposed(c) == c]  # the others fall apart before they are looked up
    out: dict[str, str] = {}
    for at in range(0, len(every), _AT_ONCE):
        part = every[at : at + _AT_ONCE]
        found = checker.getSkeleton("\n".join(part)).split("\n")
        out |= {c: decomposed(x) for c, x in zip(part, found, strict=True) if x != c}
    return out


def ensure(spark: SparkSession) -> None:
    """Ship the table to the workers of this application; called by every operator that reads texts."""
    sc = spark.sparkContext
    if _state.get("app") == sc.applicationId:
        return
    if "table" not in _state:
        _state["table"] = build(spark)
    path = f"{shared_dir(spark)}/looks-{uuid.uuid4().hex}/{NAME}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(json.dumps(_state["table"]).encode())
    out.close()
    sc.addFile(path)
    _state["app"] = sc.applicationId


@cache
def table() -> dict[str, str]:
    """The table, on the driver after `ensure`, on a worker from the shipped file."""
    if "table" not in _state:
        with open(SparkFiles.get(NAME), encoding="utf-8") as f:
            _state["table"] = json.load(f)
    return _state["table"]  # type: ignore[return-value]


@cache
def by_code() -> dict[int, str]:
    return str.maketrans(table())


_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ARABIC = "".join(map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)]))
#: Scripts whose letters a word may be brought to: their common letters. Of several with one look the first counts.
HOMES = {"LATIN": _LATIN, "ARABIC": "ي" + _ARABIC, "CYRILLIC": "".join(map(chr, [*range(0x410, 0x450), *range(0x451, 0x460), *range(0x402, 0x410)])), "GREEK": "".join(map(chr, [*range(0x391, 0x3A2), *range(0x3A3, 0x3CA)]))}


@cache
def homes(script: str) -> dict[tuple[str, bool], str]:
    """(prototype, upper case) -> the script's common letter of that look."""
    out: dict[tuple[str, bool], str] = {}
    for c in HOMES.get(script, ""):
        out.setdefault((prototype(c), c.isupper()), c)
    return out


def prototype(c: str) -> str:
    d = decomposed(c)
    return decomposed("".join(table().get(x, x) for x in d))


@cache
def home(c: str, script: str) -> str | None:
    """The common letter of a script that looks like the character, in its case; None if there is none."""
    return homes(script).get((prototype(c), c.isupper()))


@cache
def script(c: str) -> str:
    """The script of a letter, by its name."""
    if c.isascii():
        return "LATIN"
    return unicodedata.name(c, "?").split(" ", 1)[0]
