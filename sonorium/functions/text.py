"""Column expressions for names, labels, words and ratings.  All stay on the JVM."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Allophone labels of the aligner and the phonemes they stand for.
ALLOPHONES = {
    "ay": "aɪ",
    "ay0": "aɪ",
    "ae": "æ",
    "@": "ə",
    "ʌ": "ə",
    "o": "ɑ",
    "oh": "ɔ",
    "ow": "oʊ",
    "owf": "oʊ",
    "i": "ɪ",
    "iy": "i",
    "iyf": "i",
    "e": "ɛ",
    "ey": "eɪ",
    "eyf": "eɪ",
    "u": "ʊ",
    "uw": "u",
    "uwr": "u",
    "oy": "ɔɪ",
    "aw": "aʊ",
    "tuw": "u",
    "ahr": "ɑ",
    "*hr": "ər",
    "iyr": "i",
    "ah": "ə",
    "a": "ɑ",
}

# Labels of silence, by the stage that reads them.
SILENT_PHONES = ("sil", "sp", "spn", "")
SILENT_WORDS = ("", "sp", "sil", "{sl}", "{ns}", "{ls}", "{lg}", "{cg}")
SILENT_TIER = ("", "sp")

#: Modality tags that tell two recordings of one utterance apart.
MODALITIES = ("mri", "ema")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: Column | str) -> Column:
    """A number; null where there is none, and for NaN."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """All floating columns with null for NaN, as aggregates need it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats})


def stem(path: Column | str) -> Column:
    """File name without folders and without the last extension."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def recording_key(path: Column | str, modalities: tuple[str, ...] = MODALITIES) -> Column:
    """Key that recordings of one utterance share: no `_tracks`, the first modality tag taken out, lower case."""
    plain = F.replace(stem(path), F.lit("_tracks"), F.lit(""))
    return F.lower(F.regexp_replace(plain, rf"(?i)^(.*?)_(?:{'|'.join(modalities)})_", "$1_"))


def set_name(name: Column | str, modalities: tuple[str, ...] = ("ema", "mri"), token: str = "<SET>") -> Column:
    """A file name with every modality tag, in lower case and anywhere, replaced by one token."""
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(token)), modalities, col(name))


def phoneme(label: Column | str, table: dict[str, str] | None = None) -> Column:
    """The phoneme of an allophone label: an exact match, else one without a final digit; null if neither is known."""
    table = ALLOPHONES if table is None else table
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    own = F.lower(F.trim(col(label)))
    return F.coalesce(F.try_element_at(known, own), F.try_element_at(known, F.regexp_replace(own, r"^(.+)[0-9]$", "$1")))


def word_key(word: Column | str) -> Column:
    """A word trimmed and in lower case; a missing one is the word `nan`."""
    return F.coalesce(F.lower(F.trim(col(word))), F.lit("nan"))


def trailing_number(key: Column | str) -> Column:
    """The digits at the very end as a number, else null."""
    return F.regexp_extract(col(key), r"([0-9]+)$", 1).try_cast("bigint")


def stimulus(key: Column | str) -> Column:
    """The range `a_b` at the very end, else null."""
    found = F.regexp_extract(col(key), r"(?:^|[^0-9])([0-9]+_[0-9]+)$", 1)
    return F.when(found != "", found)


def max_sentence(key: Column | str) -> Column:
    """The larger number of the range at the end; else the number at the end; else null."""
    ends = F.split(stimulus(key), "_")
    return F.coalesce(F.greatest(ends[0].try_cast("bigint"), ends[1].try_cast("bigint")), trailing_number(key))


def expand_range(key: Column | str) -> Column:
    """Numbers from a to b of `a_b`, in rising order; empty where the text is no range."""
    ok = col(key).rlike(r"^[0-9]+_[0-9]+$")
    a, b = (F.split(F.when(ok, col(key)), "_")[i].try_cast("bigint") for i in (0, 1))
    return F.when(ok, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def within_inventory(key: Column | str, most: int = 37, excluded: tuple[int, ...] = (15, 21)) -> Column:
    """Whether a recording's number is at most `most` and not excluded; most = 0 lets all pass."""
    if not most:
        return F.lit(True)
    n = trailing_number(key)
    return F.coalesce((n <= most) & ~n.isin(*excluded), F.lit(False))


def within_sentences(key: Column | str, most: int = 455) -> Column:
    """Whether the highest sentence number is at most `most`; most = 0 lets all pass."""
    return F.coalesce(max_sentence(key) <= most, F.lit(False)) if most else F.lit(True)


def silent(label: Column | str, labels: tuple[str, ...] = SILENT_PHONES) -> Column:
    """Whether a label stands for silence; null does."""
    return F.coalesce(F.lower(F.trim(col(label))).isin(*labels), F.lit(True))


def plain_quotes(text: Column | str) -> Column:
    return F.translate(col(text), "’‘“”", "''\"\"")


def prompt_tokens(text: Column | str) -> Column:
    """Words of a prompt: lower case, a-z, digits and apostrophes."""
    clean = F.regexp_replace(F.lower(F.replace(col(text), F.lit("’"), F.lit("'"))), r"[^a-z0-9' ]+", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def letters_tokens(text: Column | str) -> Column:
    """Words of letters and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"([A-Za-z']+)"), 1), F.lower)


def sentences(text: Column | str) -> Column:
    """Parts between . ! ? ; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(text), r"[.!?;]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def fuzzy_equal(a: Column | str, b: Column | str) -> Column:
    """Whether words are equal but for hyphens, typographic quotes, and a final s or 's of either."""
    x, y = (F.replace(plain_quotes(c), F.lit("-"), F.lit("")) for c in (a, b))
    longer = lambda p, q: (p == F.concat(q, F.lit("s"))) | (p == F.concat(q, F.lit("'s")))
    return (x == y) | longer(x, y) | longer(y, x)


def expectation_fails(expected: Column | str, value: Column | str) -> Column:
    """Whether value breaks a rule given as text (>=4, <=2, >3, <3, =5); no value and no rule break nothing."""
    sign = F.regexp_extract(col(expected), r"^\s*(>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)", 1)
    bound = F.regexp_extract(col(expected), r"^\s*(>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)", 2).try_cast("double")
    v = col(value)
    held = F.when(sign == ">=", v >= bound).when(sign == "<=", v <= bound).when(sign == ">", v > bound).when(sign == "<", v < bound).when(sign == "=", v == bound)
    return F.coalesce(~held, F.lit(False))


def percent(rate: Column | str) -> Column:
    return F.when(col(rate).isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", 100 * col(rate)))


def half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def half_away(x: Column | str) -> Column:
    return F.when(col(x) >= 0, F.floor(col(x) + 0.5)).otherwise(F.ceil(col(x) - 0.5))


def in_window(time: Column | str, start: Column | str, end: Column | str, trim: float = 0.06) -> Column:
    """Whether a time lies in the window less a margin on both sides, or in the whole window if the margin leaves nothing."""
    a, b = col(start), col(end)
    narrow = b - trim > a + trim
    return col(time).between(F.when(narrow, a + trim).otherwise(a), F.when(narrow, b - trim).otherwise(b))


def plottable(hz: Column | str, rate: Column | str, most: float = 8000.0) -> Column:
    """Finite, positive, and below the ceiling and half the sampling rate."""
    x = col(hz)
    return F.coalesce(~F.isnan(x) & (x > 0) & (x <= F.least(F.lit(most), col(rate) / 2)), F.lit(False))


def usable_duration(seconds: Column | str, least: float = 2.0, most: float = 10.0) -> Column:
    return col(seconds).between(least, most)


def condition_id(group: Column | str, family: Column | str) -> Column:
    return F.concat_ws("__", col(group), col(family))


def condition_folder(group: Column | str, family: Column | str, plain: str = "mri") -> Column:
    """The folder of a cell: the unprocessed family is kept by group, the others by family."""
    return F.when(col(family) == plain, F.concat_ws("_", col(group), col(family))).otherwise(col(family))


def alpha_tag(alpha: Column | str) -> Column:
    a = col(alpha)
    return F.when(a.isNull(), "n/a").when(a >= 0.8, "good").when(a >= 0.667, "tentative").otherwise("low")


def direction(difference: Column | str) -> Column:
    d = col(difference)
    return F.when(d > 0, "better").when(d < 0, "worse").otherwise("no_diff")


def attention_fails(check: Column | str, right: str = "quality") -> Column:
    """Whether the attention check was answered wrongly; an empty answer passes, a missing one does not."""
    return F.coalesce(~col(check).isin(right, ""), F.lit(True))
