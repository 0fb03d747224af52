"""Text functions as column expressions. All stay in the JVM; the patterns are parameters with the domain's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions import fixed

SPACE = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_pattern(p: str) -> str:
    """Word characters, boundaries and white space as in Unicode, which Java regards on request only."""
    return f"(?U){p}"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: inside another lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trim(c: Column | str) -> Column:
    """Without white space of any kind at both ends; F.trim knows blanks only."""
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def blank(c: Column | str) -> Column:
    return F.coalesce(trim(c), F.lit("")) == ""


def not_blank_or(c: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(default))


def nulls(c: Column | str, tokens: tuple[str, ...] = fixed.NULL_TOKENS) -> Column:
    """Null for the strings that stand for it."""
    return F.when(~col(c).isin(*tokens), col(c))


def sentences(c: Column | str) -> Column:
    parts = F.split(trim(c), unicode_pattern(fixed.SENTENCE_BREAK.replace(r"\s", SPACE)))
    return F.filter(F.transform(parts, trim), lambda s: s != "")


def verdict_of(sentence: Column, code: str = fixed.CODE_PATTERN, label: str = fixed.LABEL_PATTERN, verdict: str = fixed.VERDICT_PATTERN) -> Column:
    """The first family whose pattern a sentence has: code (case counts), label or verdict; else kept."""
    has = lambda p, flags: sentence.rlike(f"(?{flags}){p}")
    return F.when(has(code, "U"), "code").when(has(label, "Ui"), "label").when(has(verdict, "Ui"), "verdict").otherwise("kept")


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, with a dot or > inside."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(unicode_pattern(r"\w+")), F.lit(0))


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct runs of k words; fewer words are one run, none are none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return let(words(c), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def signature(shingle_array: Column, n: int = 64) -> Column:
    """MinHash: the least hash of the shingles for each of n salts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(shingle_array, lambda s: F.xxhash64(s, i))))


def agreement(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def cited_papers(c: Column | str, single: str = fixed.PAPER_PATTERN, run: str = fixed.PAPER_RUN_PATTERN, one: str = fixed.PAPER_ID) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    runs = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(one), F.lit(0)))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(single), F.lit(1)), F.flatten(runs))))


def year(c: Column | str) -> Column:
    head = F.substring(col(c), 1, 4)
    return F.when(head.rlike(r"^\d{4}\z"), head.try_cast("int"))


def bare_rs(c: Column | str) -> Column:
    """An rs number without its prefix."""
    return F.regexp_replace(F.lower(trim(c)), "^r*s*", "")


def canonical_rs(c: Column | str) -> Column:
    number = trim(F.coalesce(col(c), F.lit("")))
    return F.when(number.rlike(r"\A\d+\z"), F.concat(F.lit("rs"), number))


def passage_id(paper: Column, section: Column, order: Column) -> Column:
    return F.concat_ws(":", paper, section, order.cast("string"))


def cache_key(gene: Column | str, rsid: Column | str, pages: int) -> Column:
    """Pages are part of the key: what was fetched with fewer isn't the same."""
    return F.translate(F.concat_ws("__", col(gene), not_blank_or(rsid, "nors"), F.lit(f"p{pages}")), "/", "_")


def donor_keys(rsid: Column | str, name: Column | str) -> Column:
    """What a donor may be called in its own evidence."""
    found = [F.nullif(F.regexp_extract(F.coalesce(col(name), F.lit("")), p, 1), F.lit("")) for p in fixed.DONOR_PATTERNS]
    rs = F.when(~col(rsid).isin("", "nan"), col(rsid))
    return F.array_compact(F.array(rs, *found))


def label_text(c: Column | str) -> Column:
    out = F.when(F.lit(False), "")
    for label, text in fixed.LABEL_TEXTS.items():
        out = out.when(col(c) == label, text)
    return out.otherwise(col(c))


def mixed_key(seed: int, *ids: Column | str) -> Column:
    """A reproducible random order: the digest of seed and ids, which SQL engines share."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(i).cast("string") for i in ids)))


def mixed_number(seed: int, *ids: Column | str) -> Column:
    """32 bits of it, as a number."""
    return F.conv(F.substring(mixed_key(seed, *ids), 1, 8), 16, 10).cast("long")


