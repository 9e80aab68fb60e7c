"""Quality rules: word and line counts, and divergence of a text's histograms from those of its language.

Method: the characters of a text fall into classes, and its common words into one bin each. The reference of a language is
the sum of both histograms over all rows of that language. A text fails where the Jensen-Shannon distance (base 2, from 0 to 1)
between its histogram and the reference exceeds a limit; each comparison needs a least number of characters
or common words, below which it is not made. Everything is a DataFrame expression: one pass over the texts, without any
shuffle of them, writes the counts; the references (a few rows for each language) are summed from these and
written as a table whose size the optimizer knows, so that it broadcasts them only while they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, spaced

#: Common words of the supported languages, one bin each.
COMMON_WORDS = (
    "the of and to in that this with is on by an or at be are as was not it "
    "le la les de des du et un une est que pour au dans "
    "der die das und ist ein eine den von zu mit sich auf "
    "el los las y en una por con para es se su no"
).split()

#: Small letters and white space: most of a text, in long runs.
COMMON_CHARS = r"[a-z\x20\x09-\x0D\p{Ll}\p{Lo}\p{Lm}\p{M}]+"
#: Character classes besides these; white space and all other characters are classes too. Each is counted by what its removal takes from the rest.
CLASSES = {"capital": r"[\p{Lu}\p{Lt}]+", "digit": r"\p{Nd}+", "stop": r"[.,;:!?]+", "symbol": r"[#*$%&|<>]+"}
N_CLASSES = len(CLASSES) + 2
MAX_CHAR_DISTANCE = 0.32
MAX_WORD_DISTANCE = 0.95
MIN_CHARS = 200
MIN_COMMON = 30
MIN_REFERENCE_DOCS = 20

_P = "__quality_"


def _counts(df: DataFrame, text: str) -> DataFrame:
    """df with counts of its texts under private names."""
    spelled = COMMON_WORDS + [w.capitalize() for w in COMMON_WORDS]
    kinds = len(COMMON_WORDS)
    body = F.coalesce(column(text), F.lit(""))
    df = df.withColumns({f"{_P}plain": spaced(column(text)), f"{_P}rest": F.regexp_replace(body, COMMON_CHARS, "")})
    df = df.withColumn(f"{_P}words", F.array_remove(F.split(f"{_P}plain", " "), ""))
    words, n = F.col(f"{_P}words"), F.size(f"{_P}words")
    place = F.array([F.lit(w) for w in spelled])
    common = F.transform(F.filter(words, lambda w: w.isin(spelled)), lambda w: F.chr(F.lit(65) + (F.array_position(place, w) - 1) % kinds))
    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumns({
        f"{_P}length": F.length(body).cast("long"),
        f"{_P}word_chars": F.length(F.replace(F.col(f"{_P}plain"), F.lit(" "), F.lit(""))).cast("long"),
        f"{_P}codes": F.array_join(common, ""),
        f"{_P}windows": windows,
        f"{_P}lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        **{f"{_P}n_{k}": (F.length(f"{_P}rest") - F.length(F.regexp_replace(f"{_P}rest", p, ""))).cast("long") for k, p in CLASSES.items()},
    })
    codes, windows = F.col(f"{_P}codes"), F.col(f"{_P}windows")
    df = df.withColumn(f"{_P}placed", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    placed = F.col(f"{_P}placed")
    beside = F.filter(F.transform(placed, lambda p, j: F.when((p["x"] == F.get(placed, j - 1)["x"]) | (p["x"] == F.get(placed, j + 1)["x"]), p["i"])), lambda i: i.isNotNull())
    df = df.withColumn(f"{_P}starts", F.coalesce(beside, F.array().cast("array<int>")))
    covered = F.array_distinct(F.flatten(F.transform(f"{_P}starts", lambda i: F.array(i, i + 1, i + 2))))
    spaces = F.col(f"{_P}length") - F.col(f"{_P}word_chars")
    known = [F.col(f"{_P}n_{k}") for k in CLASSES]
    rest = F.col(f"{_P}word_chars") - reduce(lambda a, b: a + b, known)
    return df.withColumns({
        f"{_P}n_words": n.cast("long"),
        f"{_P}repeat": F.size(covered).cast("long"),
        f"{_P}dup_lines": (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long"),
        f"{_P}chars": F.array(*known, spaces, rest),
        f"{_P}common": F.array([(F.length(codes) - F.length(F.replace(codes, F.lit(chr(65 + i)), F.lit("")))).cast("long") for i in range(kinds)]),
    })


def _total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)


def _distance(a: str, total_a: str, b: str, total_b: str) -> Column:
    """Jensen-Shannon distance of two histograms with their totals, all columns; null where either is empty."""
    def side(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    na, nb = F.col(total_a), F.col(total_b)
    parts = F.zip_with(a, b, lambda x, y: side(x / na, y / nb) + side(y / nb, x / na))
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2)))


def _references(counts: DataFrame) -> DataFrame:
    """For each language (null: empty) the summed histograms and the number of rows."""
    sizes = {"chars": N_CLASSES, "common": len(COMMON_WORDS)}
    sums = [F.sum(F.col(f"{_P}{k}")[i]).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    one = counts.groupBy(f"{_P}lang").agg(F.count(F.lit(1)).alias(f"{_P}docs"), *sums)
    one = one.select(f"{_P}lang", f"{_P}docs", *[F.array([F.col(f"{k}{i}") for i in range(n)]).alias(f"{_P}ref_{k}") for k, n in sizes.items()])
    return one.withColumns({f"{_P}sum_ref_{k}": _total(F.col(f"{_P}ref_{k}")).cast("double") for k in sizes})


def judge(df: DataFrame, text: str = "text", lang: str = "lang", *, keep: list[str] | None = None, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_common: int = MIN_COMMON, min_reference_docs: int = MIN_REFERENCE_DOCS, min_words: int = 50) -> DataFrame:
    """df's columns (or those in keep) and a struct `quality`.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept.
    A null or empty text has no words and fails the base rule. A null language is a language of its own. A
    language with fewer than min_reference_docs rows isn't compared. Repeated rows are judged alike and all returned; an empty table gives
    an empty one. Columns of df keep their names and values, whatever they are called (but `quality` is replaced). Windows of three
    words are compared within a text by 64-bit hashes.
    """
    columns = [c for c in (keep or df.columns) if c != "quality"]
    wanted = [f"{_P}{c}" for c in ("lang", "length", "n_words", "word_chars", "n_symbol", "dup_lines", "repeat", "chars", "common")]
    counted = _counts(df, text).withColumn(f"{_P}lang", F.coalesce(column(lang), F.lit("")))
    # Totals are written too: worked out later, they would be so again for each bin that a filter on the result looks at.
    counted = counted.withColumns({f"{_P}sum_{k}": _total(F.col(f"{_P}{k}")).cast("double") for k in ("chars", "common")})
    wanted += [f"{_P}sum_chars", f"{_P}sum_common"]
    counts = materialize(counted.select(*[column(c) for c in columns], *wanted), "quality")
    references = materialize(_references(counts), "references")
    out = counts.join(references, f"{_P}lang", "left")
    known = F.col(f"{_P}docs") >= min_reference_docs
    chars, common = ([f"{_P}{k}", f"{_P}sum_{k}", f"{_P}ref_{k}", f"{_P}sum_ref_{k}"] for k in ("chars", "common"))
    out = out.withColumns({
        f"{_P}char_distance": F.when(known & (F.col(f"{_P}length") >= min_chars), _distance(*chars)),
        f"{_P}word_distance": F.when(known & (F.col(f"{_P}sum_common") >= min_common), _distance(*common)),
    })
    failed = (F.col(f"{_P}n_words") < min_words) | (100 * F.col(f"{_P}repeat") > 50 * F.col(f"{_P}n_words"))
    near = (F.coalesce(F.col(f"{_P}char_distance"), F.lit(0.0)) <= max_char_distance) & (F.coalesce(F.col(f"{_P}word_distance"), F.lit(0.0)) <= max_word_distance)
    fields = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbol", "n_dup_lines": "dup_lines", "n_repeat_words": "repeat", "char_distance": "char_distance", "word_distance": "word_distance"}
    return out.select(*[column(c) for c in columns], F.struct(*[F.col(f"{_P}{v}").alias(k) for k, v in fields.items()], failed.alias("base_failed"), (~failed & near).alias("kept")).alias("quality"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    return judge(df, text, lang, **limits).where("quality.kept").select(*[column(c) for c in df.columns])
