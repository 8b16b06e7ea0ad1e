"""Identifiers replaced and clocks moved."""

from __future__ import annotations

import functools
import json
import re
import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters and digits of new ids; a parameter of new_ids.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def new_ids(keys: DataFrame, known: DataFrame, path: str, length: int = 8, letters: str = LETTERS, secret: str | None = None) -> DataFrame:
    """key, random_id of all keys: those known (key, random_id) and, appended to the table at path, ids of the others.

    An id is spelled from the digest of its key, a secret (drawn anew unless given) and the number of the draw, so a
    repeated task draws the same. Ids that are known, or that two keys drew, are drawn again, round by round until each
    key has one; every step is a join or a grouping by id or key. known may be read from path itself."""
    spark = keys.sparkSession
    secret = secret or secrets.token_hex(16)
    if len(set(letters)) ** length < 2:
        raise ValueError("ids need at least two letters to choose from")
    spelled = lambda draw: F.concat(*[
        F.substring(F.lit(letters), (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit(str(draw)), F.lit(str(k)), "key"), 256), 1, 12), 16, 10).cast("long") % len(letters)).cast("int") + 1, F.lit(1))
        for k in range(length)
    ])
    taken = known.select("key", "random_id")
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    open_ = keys.select("key").where("key IS NOT NULL").join(taken, "key", "left_anti").distinct()
    left, draw = open_.count(), 0
    while left:
        if draw > 1000:
            raise ValueError(f"{left} keys found no id of {length} letters")
        drawn = open_.withColumn("random_id", spelled(draw)).join(taken, "random_id", "left_anti")
        first = drawn.groupBy("random_id").agg(F.min("key").alias("key")).select("key", "random_id")
        first.write.mode("append").parquet(path)  # read from here on: later rounds see what is taken
        taken = known.select("key", "random_id").unionByName(spark.read.parquet(path)).distinct()
        open_ = keys.select("key").where("key IS NOT NULL").join(taken, "key", "left_anti").distinct()
        left, draw = open_.count(), draw + 1
    if not there.exists(here):
        return known.select("key", "random_id")
    return known.select("key", "random_id").unionByName(spark.read.parquet(path)).distinct()


def pseudonymised(text: Column, kinds: dict[str, tuple[str, str]], secret: str) -> tuple[Column, Column]:
    """The text with every identifier replaced by <kind:16 hex digits>, and what was found, in order, as an array of
    (kind, name). A kind is a pattern and the characters in which spellings of one identifier may differ; an identifier
    has one name wherever it stands, which can't be told without the secret.

    All patterns are looked for in one pass, the first kind first, so no name is searched again. Patterns must not match
    nothing, look around or have groups that capture. A null text stays null and holds nothing."""
    pattern = "|".join(f"(?:{p})" for p, _ in kinds.values())

    def named(m: Column) -> Column:
        kind, bare = F.lit(None), F.lower(m)
        for name, (own, loose) in reversed(kinds.items()):
            here = m.rlike(f"^(?:{own})$")
            kind = F.when(here, F.lit(name)).otherwise(kind)
            bare = F.when(here, F.translate(F.lower(m), loose, "")).otherwise(bare) if loose else bare
        digest = F.substring(F.sha2(F.concat_ws("|", F.lit(secret), kind, bare), 256), 1, 16)
        return F.struct(kind.alias("kind"), F.concat(F.lit("<"), kind, F.lit(":"), digest, F.lit(">")).alias("name"))

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), named)
    between = F.split(text, pattern, -1)
    whole = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b["name"], F.lit("")))), "")
    return F.when(text.isNotNull(), whole), F.coalesce(found, F.array().cast("array<struct<kind: string, name: string>>"))


@functools.lru_cache(maxsize=4096)
def _bounded(old: str) -> re.Pattern:
    return re.compile(rf"(?i)(?<![A-Za-z0-9]){re.escape(old)}(?![A-Za-z0-9])")


def _word_replaced(text: str, old: str, by: str) -> str:
    """Every place of `old`, whatever the case, where no letter or digit adjoins. Where both are ASCII no pattern is made,
    as every identity would need its own; other letters have cases of their own, which a pattern knows."""
    if not (old and old.isascii() and text.isascii()):
        return _bounded(old).sub(lambda _: by, text)
    low, old = text.lower(), old.lower()
    at, out, n = low.find(old), [], len(old)
    kept = 0
    while at >= 0:
        end = at + n
        if (at and low[at - 1].isalnum()) or low[end : end + 1].isalnum():
            at = low.find(old, at + 1)
            continue
        out += [text[kept:at], by]
        kept, at = end, low.find(old, end)
    return "".join(out) + text[kept:] if out else text


def replaced(name: str, pid: str, visit: str, new: str) -> str:
    """The row-wise twin of scalars.identity_replaced, for nested JSON."""
    for old, by in ((f"{pid}_{visit}", new), (pid, new), (visit, "V0")):
        name = _word_replaced(name, old, by)
    return name


def replaced_json(text: str, pid: str, visit: str, new: str) -> str:
    """Keys and values of a JSON text, at any depth."""

    def walk(x):
        if isinstance(x, dict):
            return {replaced(k, pid, visit, new): walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return replaced(x, pid, visit, new) if isinstance(x, str) else x

    return json.dumps(walk(json.loads(text)), ensure_ascii=False)


def json_renamed(value: Column, pid: Column, visit: Column, new: Column) -> Column:
    """JSON texts with names replaced in keys and texts at any depth; null for what isn't JSON. Nesting has no bound, so
    a small function walks it, an Arrow batch at a time."""
    def told(v: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        def one(text, *who):
            try:
                return replaced_json(text, *who) if text is not None and None not in who else None
            except ValueError:
                return None

        return pd.Series([one(*x) for x in zip(v, a, b, c, strict=True)], dtype=object)

    return F.pandas_udf(told, "string")(value, pid, visit, new)


def canonical_names(files: DataFrame, record: str = "record", label: str = "label", path: str = "path", ext: str = "ext", new: str = "random_id") -> DataFrame:
    """files with target: <id>_<label>[_<ordinal>]<ext>; an ordinal where a record has several of a label, in order of
    the path whatever its case."""
    w = Window.partitionBy(record, label, ext)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(F.lower(path), path))
    return files.withColumn("target", F.concat(F.col(new), F.lit("_"), F.col(label), F.when(n > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(F.lit("")), F.col(ext)))


def time_shift(clocks: DataFrame, by: list[str], t: str, origin: int = 946_684_800) -> DataFrame:
    """Whole seconds to add to a record's clocks so that its earliest time falls in the origin's second."""
    return clocks.groupBy(*by).agg((F.lit(origin) - F.floor(F.min(t))).cast("long").alias("delta"))


def shifted_iso(x: Column, delta: Column) -> Column:
    """An ISO date and time in UTC moved by whole seconds, with as many digits of a second as it had."""
    digits = F.regexp_extract(x, r"\.(\d+)", 1)
    base = F.to_timestamp(F.regexp_replace(F.regexp_replace(x, r"\.\d+", ""), "Z$", ""), "yyyy-MM-dd'T'HH:mm:ss")
    moved = F.date_format(F.timestamp_seconds(F.unix_timestamp(base) + delta), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(moved, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(F.lit("")), F.when(x.endswith("Z"), "Z").otherwise(""))


def without_columns(df: DataFrame, names: set[str]) -> DataFrame:
    """df without the named columns (wall-clock times), whatever the case of their names."""
    low = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in low])


def shifted_table(df: DataFrame, column: str, delta: Column) -> DataFrame:
    """A table of texts whose one clock column is moved; every other cell stays as it was written."""
    from ..functions.scalars import shifted_decimal

    return df.select(*[shifted_decimal(F.col(c), delta).alias(c) if c == column else F.col(c) for c in df.columns])
