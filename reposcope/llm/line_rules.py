"""Quality rules with cross-document line frequency; DataFrame functions only.

Per document some counts are taken within the row. Lines of any length are normalised and hashed,
the distinct documents that hold a line are counted per host (the document's source), and lines
above the limit are removed from all documents but the first of their host. A document is rejected
if it fails a base rule, or if less than ``LEAST_LEFT`` of its characters are left (it is depleted).
``judge`` tells which are kept; ``keep`` returns those with the removed lines cut from the text.

Of more than ``LINE_DOCS`` copies of a text within a host the first holder keeps its lines, and the
others are depleted; fewer copies are left to near-duplicate removal.

Cases: a null text counts as empty (no words, so it fails the base rule); a null host is a host of
its own; rows that share doc_id and text are one document and judged alike; rows that share only the
doc_id are documents judged each by its own text; a null doc_id is never the first holder of a line,
unless all are.
Other columns are ignored by ``judge`` and kept by ``keep``, but for ``n_chars``, which follows a text
that was cut; texts without such lines stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import SEPARATORS, table

LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: a line that more documents of a host hold is removed
LINE_DOCS = 20
LEAST_LEFT = 0.3

_GAP = r"[ \t-\r]+"
_INDEX_BITS = 20
_INDEX = (1 << _INDEX_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def _covered(positions: Column) -> Column:
    """Words under windows of three that begin at the positions."""
    steps = let(F.sort_array(positions), lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _positions_of_equal(grams: Column) -> Column:
    """Positions of hashes that occur twice or more, by sorting (hash, position)."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))))
    same = lambda s, x, j: F.coalesce(x["g"] == F.get(s, j)["g"], F.lit(False))
    return let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"]))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, the first included.

    Windows are 64-bit hashes. The quick way sorts one long per window: the upper bits of its hash
    and its position. Should two windows of a text share those bits and yet differ, or the positions
    not fit, the text takes the way that sorts whole hashes.
    """
    grams = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))),
    )
    upper = lambda x: F.shiftright(x, _INDEX_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_INDEX))
    near = lambda s, x, j: F.coalesce(upper(x) == upper(F.get(s, j)), F.lit(False))

    def quick(g: Column) -> Column:
        packed = F.sort_array(F.transform(g, lambda x, i: F.shiftleft(upper(x), _INDEX_BITS).bitwiseOR(i.cast("long"))))
        return let(packed, lambda s: F.filter(s, lambda x, i: near(s, x, i - 1) | near(s, x, i + 1)))

    def both(g: Column) -> Column:
        at = lambda x: F.get(g, place(x).cast("int"))
        clash = lambda d: F.exists(F.sequence(F.lit(0), F.size(d) - 1), lambda i: near(d, F.get(d, i), i + 1) & (at(F.get(d, i)) != at(F.get(d, i + 1))))
        slow = _covered(_positions_of_equal(g))
        fits = let(
            quick(g),
            lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(clash(d), slow).otherwise(_covered(F.transform(d, place))),
        )
        return F.when(F.size(g) > _INDEX, slow).otherwise(fits)

    return let(grams, both)


def base(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: its key, the counts and ``base_failed``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*_key(host), text.alias("_text"), words_of(text).alias("_words"), F.split(text, "\n").alias("_parts"))
    lines = F.filter("_parts", lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    counts = rows.select(
        *KEY,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def lines_of(docs: DataFrame, host: str = "source") -> DataFrame:
    """Lines of each row: its key, _place, _line (hash), _chars (of the line), _all (of the text)."""
    text = F.coalesce("text", F.lit(""))
    plain = F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SEPARATORS)), _GAP, " ")))
    counted = F.transform(plain, lambda x, i: F.struct(i.alias("place"), F.xxhash64(x).alias("line"), F.char_length(x).alias("chars")))
    full = F.filter(counted, lambda x: x["chars"] > 0)
    return docs.select(*_key(host), F.char_length(text).alias("_all"), F.explode(full).alias("_l")).select(
        *KEY, "_all", F.col("_l.place").alias("_place"), F.col("_l.line").alias("_line"), F.col("_l.chars").alias("_chars")
    )


KEY = ("doc_id", "_text_id", "_host")


def _key(host: str) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_id"), F.col(host).cast("string").alias("_host")]


def frequent_lines(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS) -> DataFrame:
    """Lines that more than ``limit`` documents of a host hold, with the first holder's id."""
    return (
        lines_of(docs, host)
        .groupBy("_host", "_line", "_text_id", "doc_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_host", "_line")
        .agg(F.count("*").alias("_docs"), F.min("doc_id").alias("_first"))
        .filter(F.col("_docs") > limit)
    )


def removed(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS) -> DataFrame:
    """Per key of a row with removed lines: _removed (their characters), _all (the text's) and _places."""
    # dealt evenly once more, so that a line which very many rows hold can be split in the join
    frequent = frequent_lines(docs, host, limit).select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), "_first").hint("rebalance")
    here = F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_l"))
    hits = lines_of(docs, host).join(frequent, here).filter(~F.col("doc_id").eqNullSafe(F.col("_first")))
    once = hits.groupBy(*KEY, "_place").agg(F.max("_chars").alias("_chars"), F.max("_all").alias("_all"))  # repeated rows count once
    return once.groupBy(*KEY).agg(F.sum("_chars").alias("_removed"), F.max("_all").alias("_all"), F.collect_list("_place").alias("_places"))


def _is_depleted(least_left: float) -> Column:
    return F.col("_all") - F.col("_removed") < least_left * F.col("_all")


def depleted(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Keys of the rows that keep less than ``least_left`` of their characters, with ``_removed``."""
    return removed(docs, host, limit).filter(_is_depleted(least_left)).select(*_other_key(), "_removed")


def _other_key() -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in KEY]


def _same_key() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_id") == F.col("__text_id")) & F.col("_host").eqNullSafe(F.col("__host"))


def judge(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept."""
    rows = base(docs, host).join(depleted(docs, host, limit, least_left), _same_key(), "left")
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("_removed").isNull()).alias("kept"))


def keep(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that are not rejected, with all their columns and without the removed lines."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # so that no name clashes
    row = docs.select(whole, *_key(host), words_of(F.coalesce("text", F.lit(""))).alias("_words"))
    n, again = F.size("_words"), repeated_words(F.col("_words"))
    good = row.filter((n >= LEAST_WORDS) & (100 * again <= REPEATED_PERCENT * n)).drop("_words")
    hits = removed(docs, host, limit).select(*_other_key(), "_removed", _is_depleted(least_left).alias("_depleted"), "_places")
    left = good.join(hits, _same_key(), "left").filter(F.col("_removed").isNull() | ~F.col("_depleted"))
    left = left.select("_row", F.when(F.col("_removed").isNotNull(), without(F.col("_row")["text"], F.col("_places"))).alias("_cut"))
    put = {"text": F.col("_cut"), "n_chars": F.char_length("_cut")}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    old = lambda c: F.col("_row")[c]
    return left.select(*((F.when(F.col("_cut").isNull(), old(c)).otherwise(put[c].cast(kinds[c])) if c in put else old(c)).alias(c) for c in docs.columns))


def without(text: Column, places: Column) -> Column:
    """The text without the lines at the places."""
    rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places)
    return let(F.split(text, "\n"), lambda x: F.array_join(F.transform(rest(x), lambda i: F.get(x, i)), "\n"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_CLASS = r"[^\x20\x09-\x0D]"
_TRIM = r"regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')"
OP3_SQL = f"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
     w as (select doc_id, source, text, regexp_extract_all(text, '{_CLASS}+') as ws, string_split(text, chr(10)) as ls from t),
     g as (select doc_id, i, ws[i:i + 2] as win from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
     r as (select doc_id, count(distinct j) as n from (
             select doc_id, unnest(range(i, i + 3)) as j from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g) where c > 1) group by 1),
     b as (select doc_id, source, text, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
             cast(len(list_filter(ls, lambda x: regexp_matches(x, '{_CLASS}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{_CLASS}')))) as bigint) as n_dup_lines,
             coalesce(n, 0) as n_repeat_words
           from w left join r using (doc_id)),
     l as (select doc_id, source, text, lower({_TRIM}) as line from (select doc_id, source, text, unnest(ls) as l from w)),
     s as (select doc_id, source, text, line from l where line <> ''),
     f as (select source, line, min(doc_id) as first from s group by 1, 2 having count(distinct doc_id) > {LINE_DOCS}),
     x as (select doc_id, sum(length(line)) as removed from s join f using (source, line) where doc_id <> first group by 1),
     j as (select b.*, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words as base_failed,
             removed is not null and length(text) - removed < {LEAST_LEFT} * length(text) as depleted
           from b left join x using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not depleted as kept from j
"""
