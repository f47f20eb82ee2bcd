"""Text normalisation and character statistics as Column expressions.

Fixed values below (character classes, thresholds, word lists) are part of the required results.
"""

from __future__ import annotations

import unicodedata
from dataclasses import asdict, dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
ZWNJ, ZWJ, TATWEEL, NBSP = "\u200c", "\u200d", "\u0640", "\u00a0"
HARAKAT = "".join(map(chr, range(0x064B, 0x0653))) + "\u0670\u0655\u0654\u0653"
YEH_KAF = ("\u064a\u0649\u06d2\u0643\u06aa", "\u06cc\u06cc\u06cc\u06a9\u06a9")
ALEF_HAMZA = ("\u0623\u0625\u0672\u0673\u0671", "\u0627" * 5)
ALEF_MADDA = ("\u0622", "\u0627")
TEH_MARBUTA = ("\u0629", "\u0647")
DIGITS = ("\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "0123456789" * 2)
PUNCTUATION = (",;?", "\u060c\u061b\u061f")
SEPARATORS = ("\u066b\u066c\u2044", ".,/")
SPACES = " \\t\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000"
ARABIC_CLASS = "[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff]"
PERSIAN_CORE = "[ء-يٰ-ۓۺ-ۼ‌]+"
PERSIAN_ONLY = "[\u067e\u0686\u0698\u06af]"
VOWEL_MARKS = "[\u064b-\u0652\u0670]"
DOT_GROUPS = ("بپتثنی", "جچحخ", "دذ", "رزژ", "سش", "صض", "طظ", "عغ", "فق", "کگ", "هة", "وؤ", "اآأإ")
#: Presentation forms of each letter: alone, behind another, before another, between two; letters that do not join
#: forward have the first two, and hamza the first.
FORMS = {
    "آ": (0xFE81, 0xFE82), "أ": (0xFE83, 0xFE84), "إ": (0xFE87, 0xFE88), "ا": (0xFE8D, 0xFE8E),
    "د": (0xFEA9, 0xFEAA), "ذ": (0xFEAB, 0xFEAC), "ر": (0xFEAD, 0xFEAE), "ز": (0xFEAF, 0xFEB0),
    "ژ": (0xFB8A, 0xFB8B), "و": (0xFEED, 0xFEEE), "ؤ": (0xFE85, 0xFE86), "ة": (0xFE93, 0xFE94),
    "ى": (0xFEEF, 0xFEF0), "ء": (0xFE80,),
} | {
    letter: tuple(range(first, first + 4))
    for letter, first in {
        "ب": 0xFE8F, "پ": 0xFB56, "ت": 0xFE95, "ث": 0xFE99, "ج": 0xFE9D, "چ": 0xFB7A, "ح": 0xFEA1, "خ": 0xFEA5,
        "س": 0xFEB1, "ش": 0xFEB5, "ص": 0xFEB9, "ض": 0xFEBD, "ط": 0xFEC1, "ظ": 0xFEC5, "ع": 0xFEC9, "غ": 0xFECD,
        "ف": 0xFED1, "ق": 0xFED5, "ک": 0xFB8E, "ك": 0xFED9, "گ": 0xFB92, "ل": 0xFEDD, "م": 0xFEE1, "ن": 0xFEE5,
        "ه": 0xFEE9, "ی": 0xFBFC, "ي": 0xFEF1, "ئ": 0xFE89,
    }.items()
}
# ------------------------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rules:
    """Which normalisation rules apply; the order is fixed."""

    nfc: bool = True
    strip_bidi: bool = True
    strip_zwj: bool = True
    strip_tatweel: bool = True
    strip_harakat: bool = True
    arabic_to_persian: bool = True
    fold_alef: bool = True
    fold_alef_madda: bool = False
    fold_teh_marbuta: bool = True
    digits_to_ascii: bool = True
    fold_punctuation: bool = True
    strip_zwnj: bool = True
    lowercase_latin: bool = False
    collapse_whitespace: bool = True

    @classmethod
    def only(cls, *names: str) -> Rules:
        return cls(**{f.name: f.name in names for f in fields(cls)})

    def names(self) -> list[str]:
        return [k for k, v in asdict(self).items() if v]


DEFAULT = Rules()
RAW = Rules.only()
#: For Latin-script corpora: no letters of other scripts are folded.
LATIN = Rules.only("nfc", "strip_bidi", "strip_zwj", "strip_zwnj", "lowercase_latin", "collapse_whitespace")


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; only texts with combining or compatibility characters leave the JVM."""
    return F.when(text.rlike("[\u0300-\u036f\u0653-\u0655\u0340-\u0345\u1100-\u11ff\u2126\u212a\u212b\uf900-\ufaff\ufb1d-\ufb4e]"), _nfc(text)).otherwise(text)


def collapse(text: Column) -> Column:
    """One space for a run of spaces, one line end for a run with line ends, and no space at either end of a line."""
    # Runs are tried at their first blank alone, so that a long run costs no more than its length.
    ends = r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]*+\n\s*+"
    text = F.regexp_replace(text, ends, "\n")
    text = F.regexp_replace(text, f"[{SPACES}]++", " ")
    text = F.regexp_replace(text, ends, "\n")
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


_STEPS = {
    "nfc": nfc,
    "strip_bidi": lambda t: F.translate(t, BIDI, ""),
    "strip_zwj": lambda t: F.translate(t, ZWJ, ""),
    "strip_tatweel": lambda t: F.translate(t, TATWEEL, ""),
    "strip_harakat": lambda t: F.translate(t, HARAKAT, ""),
    "arabic_to_persian": lambda t: F.translate(t, *YEH_KAF),
    "fold_alef": lambda t: F.translate(t, *ALEF_HAMZA),
    "fold_alef_madda": lambda t: F.translate(t, *ALEF_MADDA),
    "fold_teh_marbuta": lambda t: F.translate(t, *TEH_MARBUTA),
    "digits_to_ascii": lambda t: F.translate(t, *DIGITS),
    # Commas fold before the thousands separator turns into one, so grouped digits are told apart.
    "fold_punctuation": lambda t: F.translate(F.translate(t, *PUNCTUATION), *SEPARATORS),
    "strip_zwnj": lambda t: F.translate(t, ZWNJ, " "),
    "lowercase_latin": lambda t: F.translate(t, UPPER, LOWER),
    "collapse_whitespace": collapse,
}


def normalize(text: Column, rules: Rules = DEFAULT) -> Column:
    """Normalised text; null becomes empty, so callers test for null first."""
    text = F.coalesce(text, F.lit(""))
    for name in rules.names():
        text = _STEPS[name](text)
    return text


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def skeleton(word: Column) -> Column:
    """Every letter folded onto the first of its dot group."""
    source = "".join(g[1:] for g in DOT_GROUPS)
    target = "".join(g[0] * (len(g) - 1) for g in DOT_GROUPS)
    return F.translate(word, source, target)


def fold_groups(word: Column, groups: tuple[str, ...]) -> Column:
    return F.translate(word, "".join(g[1:] for g in groups), "".join(g[0] * (len(g) - 1) for g in groups))


def match_key(word: Column) -> Column:
    """Form under which readings of one word are compared."""
    return F.regexp_replace(F.translate(F.translate(word, TATWEEL + ZWNJ + HARAKAT, ""), *YEH_KAF), r"(?U)\s+", "")


def script_of(char: Column) -> Column:
    return (
        F.when(char.rlike(r"^(?U)\s"), "space")
        .when(char.rlike("^[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff]"), "arabic")
        .when(char.rlike("^[A-Za-z]"), "latin")
        .when(char.rlike(r"^\p{Nd}"), "digit")
        .when(char.rlike(r"^\p{P}"), "punct")
        .otherwise("other")
    )


def count_of(text: Column, char_class: str) -> Column:
    return F.regexp_count(text, F.lit(char_class)).cast("long")


#: Census of the characters that normalisation acts on.
CENSUS = {
    "arabic_yeh": "\u064a",
    "arabic_kaf": "\u0643",
    "alef_maksura": "\u0649",
    "teh_marbuta": "\u0629",
    "zwnj": ZWNJ,
    "zwj": ZWJ,
    "tatweel": TATWEEL,
    "harakat": f"[{HARAKAT}]",
    "bidi_controls": f"[{BIDI}]",
    "persian_digits": "[\u06f0-\u06f9]",
    "arabic_digits": "[\u0660-\u0669]",
    "latin_digits": "[0-9]",
}


def census(text: Column, classes: dict[str, str] | None = None) -> dict[str, Column]:
    known = F.coalesce(text, F.lit(""))
    return {name: count_of(known, c) for name, c in (classes or CENSUS).items()}


def legibility(text: Column, script: str = ARABIC_CLASS, least_share: float = 0.60, least_chars: int = 8, least_words: int = 4) -> dict[str, Column]:
    """Whether a transcript is in the expected script: chars, share, latin_words, legible."""
    known = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(known, r"(?U)\s", "")
    chars = F.length(bare).cast("long")
    hits = count_of(bare, script)
    share = F.when(chars == 0, F.lit(0.0)).otherwise(hits / chars)
    words = count_of(known, "[A-Za-z]{4,}")
    legible = (
        F.when(chars == 0, True)
        .when(chars < least_chars, (hits > 0) | (words > 0))
        .otherwise((share >= least_share) | (words >= least_words))
    )
    return {"chars": chars, "share": share, "latin_words": words, "legible": legible}


def looks_arabic(text: Column, marks: str = VOWEL_MARKS, own: str = PERSIAN_ONLY) -> Column:
    """Vocalised, or long and without the letters that only the other language has."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    n = F.length(bare)
    marked = count_of(bare, marks) * 100.0 / n >= 0.30
    unlike = count_of(bare, own) * 100.0 / n < 0.80
    return F.when(n < 40, False).when(marked, True).otherwise((n >= 200) & unlike)


def token_set(text: Column, core: str = PERSIAN_CORE, rules: Rules = DEFAULT) -> Column:
    """Distinct normalised words of the script: the first run of its letters in each token that has one."""
    known = F.coalesce(text, F.lit(""))
    if rules.nfc:  # of the whole text, as it may leave the JVM
        known, rules = nfc(known), replace(rules, nfc=False)
    # Equal tokens are taken once before any rule runs on them: a text has far fewer distinct ones.
    tokens_ = F.array_distinct(F.split(known, " "))
    parts = F.array_distinct(F.filter(F.transform(tokens_, lambda t: F.regexp_extract(t, core, 0)), lambda w: w != ""))
    return F.array_distinct(F.filter(F.transform(parts, lambda w: normalize(w, rules)), lambda w: w != ""))


def shape(word: Column) -> Column:
    """A word in joined presentation forms, in the order in which they are drawn from the left.

    A letter has its final or middle form behind one that joins forward, and its first or middle form
    before another one if it joins forward itself; characters without forms are left out.
    """
    forms = F.create_map(*(F.lit(x) for c, codes in FORMS.items() for x in (c, "".join(map(chr, codes)))))
    letters = F.filter(F.transform(F.split(word, ""), lambda c: F.try_element_at(forms, c)), lambda f: f.isNotNull())

    def place(all_: Column) -> Column:
        last = F.size(all_) - 1

        def form(f: Column, i: Column) -> Column:
            behind = (i > 0) & (F.length(F.element_at(all_, F.greatest(i, F.lit(1)))) == 4)
            before = (F.length(f) == 4) & (i < last)
            at = F.when(behind & before, 4).when(behind & (F.length(f) > 1), 2).when(before, 3).otherwise(1)
            return F.substring(f, at, F.lit(1))

        return F.transform(all_, form)

    return F.array_join(F.reverse(F.element_at(F.transform(F.array(letters), place), 1)), "")


def clean_label(text: Column) -> Column:
    """Training label: marks and controls stripped, letter forms folded, one space between words."""
    t = F.translate(F.coalesce(text, F.lit("")), "\u200e\u200f" + TATWEEL + HARAKAT, "")
    t = F.translate(F.translate(t, *YEH_KAF), "\u06c0", "\u0647")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_word(word: Column) -> Column:
    """Bidi controls out, letter forms folded, vowel marks out where there are two or more."""
    t = F.translate(F.translate(word, BIDI, ""), *YEH_KAF)
    return F.when(count_of(t, f"[{HARAKAT}]") >= 2, F.translate(t, HARAKAT, "")).otherwise(t)


def contained(value: Column, page: Column) -> Column:
    """Whether a value stands on a page, with letter forms folded and punctuation runs as one blank."""

    def fold(t: Column) -> Column:
        t = F.translate(F.coalesce(t, F.lit("")), *YEH_KAF)
        return F.trim(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}]+", " "))

    return F.contains(fold(page), fold(value))


def runs_of(text: Column, char_class: str) -> Column:
    """All runs of a class, joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{char_class}+"), F.lit(0)), " ")


def head_and_rest(text: Column) -> tuple[Column, Column]:
    """Text before and after the first line end."""
    parts = F.split(text, "\n", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def count_text(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def differing_tokens(before: Column, after: Column) -> Column:
    """(pos, before, after) of the places where two token lists of equal length differ."""
    pairs = F.zip_with(before, after, lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["before"].alias("before"), p["after"].alias("after")))
    return F.filter(placed, lambda p: ~p["before"].eqNullSafe(p["after"]))
