"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that normalisation deletes and folds.
DIACRITICS = r"[ؐ-ًؚ-ٟۖ-ۭ]"
ALEFS, ALEF = "آأإ", "ا"
YEHS, YEH = "ىيی", "ي"
#: White space but line feeds. Ends of such runs are found by possessive quantifiers behind a lookbehind: a run that isn't
#: matched at its first character is not tried again at each of the others, so that the time is linear in it.
BLANK = r"[\s&&[^\n]]"

# The repairs of text whose PDF font turned hamza forms into U or %, in the order in which they apply.
ARABIC = r"([؀-ۿ])"
REPAIRS = [
    ("اUﺣـ?ﻮال", "الأحوال"),
    ("اUﺷـ?ﺨﺎص", "الأشخاص"),
    ("اUوﻟﻴـ?ﺔ", "الأولية"),
    ("اUزﻣـ?ﺎت", "الأزمات"),
    ("اUﻛﺜـ?ﺮ", "أكثر"),
    ("اUﻟﻔـ?ﺔ", "الألفة"),
    (r"اU[ـ\s]*" + ARABIC, "الأ$1"),
    ("اU" + ARABIC, "الأ$1"),
    ("اU" + ARABIC, "الأ$1"),
    (r"اU\s+" + ARABIC, "الأ $1"),
    (r"Uن\s", "أن "),
    ("Uن" + ARABIC, "أن$1"),
    ("ا%وﻟﻴﺔ", "الأولية"),
    ("ا%" + ARABIC, "الأ$1"),
    ("Uﺷخاص", "أشخاص"),
    ("Uﺷ" + ARABIC, "أش$1"),
    ("Uز" + ARABIC, "أز$1"),
    ("Uﻛثر", "أكثر"),
    ("Uﻛ" + ARABIC, "أك$1"),
    ("Uم" + ARABIC, "أم$1"),
    ("Uل" + ARABIC, "أل$1"),
    ("Uت" + ARABIC, "أت$1"),
    ("Uد" + ARABIC, "أد$1"),
    ("Uر" + ARABIC, "أر$1"),
    ("Uب" + ARABIC, "أب$1"),
    ("Uف" + ARABIC, "أف$1"),
    ("Uق" + ARABIC, "أق$1"),
    ("Uع" + ARABIC, "أع$1"),
    ("Uص" + ARABIC, "أص$1"),
    ("Uه" + ARABIC, "أه$1"),
    ("Uي" + ARABIC, "أي$1"),
    ("Uو" + ARABIC, "أو$1"),
    ("Uا" + ARABIC, "أ$1"),
    ("U" + ARABIC, "أ$1"),
]
# Marks that a generator leaves in its answers.
SENTINELS = ["<extra_id_0>", "<extra_id_1>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def normalize_arabic(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, DIACRITICS, ""), ALEFS + YEHS, ALEF * len(ALEFS) + YEH * len(YEHS))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def tokenize(c: Column) -> Column:
    """Normalised tokens between white space; case and punctuation stay."""
    return words(normalize_arabic(c))


def repair(c: Column) -> Column:
    """The repairs, of texts that hold a U or % and Arabic letters (all patterns need both); others are as they are."""
    marked = (F.contains(c, F.lit("U")) | F.contains(c, F.lit("%"))) & c.rlike("[\u0600-\u06ff\ufb50-\ufdff\ufe70-\ufeff]")
    return F.when(marked, _repaired(c)).otherwise(c)


def _repaired(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, "(?U)" + rule[0] if r"\s" in rule[0] else rule[0], rule[1]), REPAIRS, c)


def strip_cid(c: Column) -> Column:
    c = F.regexp_replace(c, r"\(cid:\d+\)", "")
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"\n{4,}", "\n\n\n")


def _tidy_lines(c: Column) -> Column:
    """Lines stripped, runs of blank lines to one, runs of blanks and tabs to one blank, line ends stripped."""
    c = F.regexp_replace(c, rf"(?U)(?:\G|(?<!{BLANK})){BLANK}*+\n{BLANK}*+", "\n")
    c = F.regexp_replace(strip_blanks(c), r"\n{2,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), rf"(?U)(?<!{BLANK}){BLANK}++(?=\n|\z)", "")


def strip_blanks(c: Column) -> Column:
    """White space but line feeds off both ends."""
    return F.regexp_replace(c, rf"(?U)\A{BLANK}++|(?<!{BLANK}){BLANK}++\z", "")


def clean_for_rag(c: Column) -> Column:
    c = F.regexp_replace(_tidy_lines(repair(F.coalesce(c, F.lit("")))), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", ""))


def clean_ocr(c: Column) -> Column:
    return strip(_tidy_lines(F.coalesce(c, F.lit(""))))


def truncate(c: Column, n: int = 300) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int = 200) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def arabic_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^؀-ۿ]", "")).cast("long")


def single_letter_share(c: Column) -> Column:
    w = words(c)
    return F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}$"))) / F.greatest(F.size(w), F.lit(1))


def is_heavily_corrupt(c: Column, words_over: int = 10, share: float = 0.4) -> Column:
    return (F.size(words(c)) > words_over) & (single_letter_share(c) > share)


def too_few_distinct(words: Column, distinct: Column, words_over: int = 20, share: float = 0.3) -> Column:
    return (words > words_over) & (distinct < words * F.lit(share))


def is_repetitive(c: Column, words_over: int = 20, share: float = 0.3) -> Column:
    w = words(c)
    return too_few_distinct(F.size(w), F.size(F.array_distinct(w)), words_over, share)


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), F.lit(False))


def looks_like_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{N}") & c.rlike("[-:]"), F.lit(False))


def identifier(c: Column, n: int = 50) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", ""), 1, n)


def doc_id_of_url(url: Column) -> Column:
    """The URL's last path segment as an identifier."""
    return identifier(F.regexp_extract(F.regexp_replace(url, "(?<!/)/++$", ""), "([^/]*)$", 1))


def collapsed(c: Column) -> Column:
    """White space runs as one blank: the key of text dedup."""
    return F.array_join(words(c), " ")


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def clean_answer(c: Column) -> Column:
    return strip(reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit("")), SENTINELS, c))


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Optional content filter; the patterns are the caller's."""
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns], F.lit(False))


def paraphrase_lines(generated: Column, source: Column, most: int, shortest: int = 5) -> Column:
    """Distinct lines (ignoring case) of a generated text that are long enough and not the source, in order."""
    lines = F.filter(F.transform(F.split(generated, "\n"), strip), lambda x: (F.length(x) >= shortest) & (F.lower(x) != F.lower(strip(source))))
    fresh = F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(fresh, 1, most)
