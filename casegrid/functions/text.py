"""Names, case ids and approximate comparison as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.nulls import no_key_name, no_name, null_like, text, trim

CASE_ID = r"\b[A-Z]{3}[0-9]{3}\b"
#: Letters of the Latin blocks that decompose into an ASCII letter and marks, and those letters.
_ACCENTED, _PLAIN = zip(*((c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()), strict=True)


#: Letters that stand for others without being made of them.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
STROKES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D", "ı": "i"}


def plain(c: Column | str) -> Column:
    """Latin letters without their accents and strokes, ligatures as two letters; all else as it is."""
    out = F.translate(text(c), "".join((*_ACCENTED, *STROKES)), "".join((*_PLAIN, *STROKES.values())))
    for one, two in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def squish(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def letters(c: Column | str) -> Column:
    """Lower case, all but ASCII letters and blanks deleted."""
    return F.lower(F.regexp_replace(text(c), "[^a-zA-Z ]", ""))


def _words(c: Column, least: int) -> Column:
    return F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) >= least))


def name_tokens(c: Column | str, least: int = 3) -> Column:
    """Sorted words of a name with at least ``least`` letters; none for a missing name."""
    return F.when(no_name(c), F.array().cast("array<string>")).otherwise(_words(letters(c), least))


def name_key(c: Column | str, least: int = 2) -> Column:
    """A name's words in order, without case and accents; null if there are none."""
    key = F.array_join(_words(plain(F.lower(trim(c))), least), " ")
    return F.when(~no_key_name(c), F.nullif(key, F.lit("")))


def case_ids(c: Column | str) -> Column:
    """The case ids written in a text, as they are, each once in order of appearance."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text(c), F.lit(CASE_ID), F.lit(0)), F.array().cast("array<string>")))


def case_ids_upper(c: Column | str) -> Column:
    return case_ids(F.upper(text(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


#: The longest pattern whose columns of an edit table fit the bits of a long, with room for one carry.
BITS = 62


def edits_allowed(p: Column, share: float = 0.2) -> Column:
    return F.ceil(F.length(p) * share).cast("int")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def least_edits(p: Column, x: Column) -> Column:
    """The fewest edits that make ``p`` (1 to BITS letters) any part of ``x``.  One column of the edit table is two words of bits, where
    it rises and where it falls from row to row; a letter of ``x`` gives the next column by a few operations on them."""
    m = F.length(p)
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), m) - 1
    letters_of = F.split(p, "")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    where = lambda c: F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.get(letters_of, i) == c, acc.bitwiseOR(bit(i))).otherwise(acc))
    masks = F.map_from_entries(F.transform(F.array_distinct(letters_of), lambda c: F.struct(c, where(c))))
    zero = F.struct(masks.alias("masks"), full.alias("full"), full.alias("up"), F.lit(0).cast("bigint").alias("down"), m.alias("score"), m.alias("best"))

    def step(acc: Column, c: Column) -> Column:
        eq = F.coalesce(F.try_element_at(acc["masks"], c), F.lit(0).cast("bigint"))

        def column(e: Column) -> Column:
            up, down, all_ = acc["up"], acc["down"], acc["full"]
            level = (e.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(e)

            def rows(h: Column) -> Column:
                more = down.bitwiseOR(F.bitwise_not(h.bitwiseOR(up)).bitwiseAND(all_))
                return F.struct(more.alias("more"), up.bitwiseAND(h).alias("less"), e.bitwiseOR(down).alias("v"))

            return _let(level, rows)

        def close(t: Column) -> Column:
            top = F.length(p) - 1
            at = lambda w: F.call_function("shiftright", w, top).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
            score = acc["score"] + at(t["more"]) - at(t["less"])
            more = F.call_function("shiftleft", t["more"], F.lit(1)).bitwiseAND(acc["full"])
            less = F.call_function("shiftleft", t["less"], F.lit(1)).bitwiseAND(acc["full"])
            up = less.bitwiseOR(F.bitwise_not(t["v"].bitwiseOR(more)).bitwiseAND(acc["full"]))
            return F.struct(acc["masks"].alias("masks"), acc["full"].alias("full"), up.alias("up"), more.bitwiseAND(t["v"]).alias("down"), score.alias("score"), F.least(acc["best"], score).alias("best"))

        return _let(_let(eq, column), close)

    return F.aggregate(F.split(x, ""), zero, step, lambda acc: acc["best"])


def near(a: Column, b: Column, share: float = 0.2) -> Column:
    """Whether some part of ``b`` is within ceil(share * length) edits of ``a``, without regard to case."""
    p, x = F.lower(a), F.lower(b)
    k = edits_allowed(p, share)
    sizes = F.sequence(F.greatest(F.length(p) - k, F.lit(1)), F.length(p) + k)
    windows = F.exists(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.exists(sizes, lambda n: F.levenshtein(p, F.substring(x, i, n)) <= k))
    hit = F.when(F.length(p) <= BITS, least_edits(p, x) <= k).otherwise(windows)
    return F.when((p == x) | ((F.length(p) > 0) & x.contains(p)), True).when((F.length(p) > 0) & (F.length(x) > 0) & (F.length(x) + k >= F.length(p)), hit).otherwise((p == x) & F.lit(False))


def near_either_way(a: Column, b: Column) -> Column:
    return near(a, b) | near(b, a)


ID_LISTS = ("contacts", "secondary_cases", "potential_infector", "most_probable_infector")


def _short_name(c: Column) -> Column:
    return F.array_join(_words(letters(c), 2), " ")


def cells_match(a: Column | str, b: Column | str, column: str) -> Column:
    """Typed equality of an extracted and a true cell: id lists as sets, names approximately, anything else without
    case, accents and kind of separator.  Two missing cells match, a missing one matches nothing."""
    a, b = text(a), text(b)
    if column in ID_LISTS:
        x, y = case_ids(a), case_ids(b)
        same = F.when((F.size(x) == 0) & (F.size(y) == 0), True).otherwise((F.size(x) > 0) & (F.size(y) > 0) & same_set(x, y))
    elif column == "name":
        x, y = _short_name(a), _short_name(b)
        same = (x != "") & (y != "") & near_either_way(x, y)
    else:
        one = lambda c: F.lower(trim(F.regexp_replace(plain(c), r"[-_\s]+", " ")))
        same = one(a) == one(b)
    return F.when(null_like(a) & null_like(b), True).when(null_like(a) | null_like(b), False).otherwise(F.coalesce(same, F.lit(False)))


def reference_ids(c: Column | str) -> Column:
    """The ids that a cell lists: a JSON array, or parts between ``, ; |`` and line ends, without quotes, each once."""
    c = text(c)
    parts = F.when(c.rlike(r"^\s*\[[\s\S]*\]\s*$"), F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"\s*[,;\n|]+\s*"))).otherwise(F.split(c, r"\s*[,;\n|]+\s*"))
    clean = F.transform(parts, lambda x: F.regexp_replace(trim(x), '^"+|"+$', ""))
    kept = F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin("null", "na", "none")))
    none = c.isNull() | F.lower(trim(c)).isin("", "null", "na", "none", "[]")
    return F.when(none, F.array().cast("array<string>")).otherwise(kept)


def date_variants(c: Column | str) -> Column:
    """How a DD/MM/YYYY date may be written in a text; any other value only as it is."""
    c = text(c)
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    day = F.split(c, "/")[0].cast("int")
    month = F.try_element_at(F.array(*map(F.lit, months)), F.nullif(F.split(c, "/")[1].cast("int"), F.lit(0)))
    year = F.split(c, "/")[2]
    spelled = F.filter(F.array(c, F.concat_ws(" ", day, month, year), F.concat_ws(" ", day, F.lower(month), year), F.concat_ws(" ", day, month)), lambda x: x.isNotNull())
    return F.when(c.isNull() | (trim(c) == ""), F.array().cast("array<string>")).when(c.rlike(r"^\d{2}/\d{2}/\d{4}$") & month.isNotNull(), spelled).otherwise(F.array(c))
