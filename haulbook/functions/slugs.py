"""URL slugs of carriers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulbook.functions.cleaning import col

SLUG_WIDTH = 200

# Letters without a decomposition; fixed values.
_SPELLED_OUT = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ŋ": "ng"}
_PLAIN = {"ð": "d", "đ": "d", "ø": "o", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t"}

# Greek and Cyrillic letters as they are written in Latin ones; fixed values.
_GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k",
    "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t",
    "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "iu", "я": "ia", "ђ": "dj", "є": "ie", "ѕ": "dz", "і": "i", "ј": "j", "љ": "lj", "њ": "nj",
    "ћ": "tsh", "џ": "dzh", "ґ": "g",
}
_OTHERS = _GREEK | _CYRILLIC

# Where letters with a decomposition lie: Latin to the end of its first extensions, Greek and
# Cyrillic, Latin and Greek additions (Vietnamese), ligatures and wide letters.
_BLOCKS = ((0xDF, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFB00, 0xFB07), (0xFF10, 0xFF5B))
#: Combining marks, which decomposed texts have behind their letters.
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _folded_letters(begin: int, end: int) -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters of a block and what they become, one letter and several, by
    decomposition."""
    one, several = {}, {}
    for letter in map(chr, range(begin, end)):
        if letter != letter.lower() or letter in _SPELLED_OUT:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        out = "".join(_PLAIN.get(c, _OTHERS.get(c, c)) for c in bare)
        if out != letter and out.isascii() and (out == "" or out.isalnum()):
            (one if len(out) < 2 else several)[letter] = out
    return one, several


def _translation(blocks) -> tuple[str, str, dict[str, str]]:
    """What `translate` and `replace` need. `translate` drops what has no partner, so letters
    that vanish come last."""
    one, several = {}, {}
    for block in blocks:
        for whole, part in zip((one, several), _folded_letters(*block)):
            whole |= part
    kept = [k for k, v in one.items() if v]
    gone = [k for k, v in one.items() if not v]
    return "".join(kept + gone) + _MARKS, "".join(one[k] for k in kept), several


_LATIN, _BEYOND = _translation(_BLOCKS[:1]), _translation(_BLOCKS[1:])
_PAST_LATIN = r"[\x{300}-\x{52F}\x{1E00}-\x{1FFF}\x{FB00}-\x{FB06}\x{FF10}-\x{FF5A}]"


def fold_letters(lowered: Column) -> Column:
    """Latin, Greek and Cyrillic letters to ASCII; text that has none of them skips the work."""

    latin = F.translate(lowered, _LATIN[0], _LATIN[1])
    for letter, spelled in (_LATIN[2] | _SPELLED_OUT).items():
        latin = F.replace(latin, F.lit(letter), F.lit(spelled))
    # Letter by letter, in one expression: there are many that become several.
    spelled = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in _BEYOND[2].items())), F.lit(","), F.lit(":"))
    letters = F.split(F.translate(latin, _BEYOND[0], _BEYOND[1]), "")
    told = F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(spelled, x), x)), "")
    beyond = F.when(lowered.rlike(_PAST_LATIN), told).otherwise(latin)
    return F.when(F.octet_length(lowered) == F.length(lowered), lowered).otherwise(beyond)


#: Letters that are a base letter and a mark.
_MARKED = "".join(c for c in _LATIN[0] if unicodedata.decomposition(c) and not c.isdigit())
_UNMARKED = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)


def decode_references(lowered: Column) -> Column:
    """Numeric character references (`&#39;`, `&#xe9;`) to their signs. A letter with a mark
    becomes the letter and a dash: it is taken apart, but its mark is not dropped any more."""

    def decode(part: Column) -> Column:
        number = F.regexp_extract(part, "^([0-9]+|x[0-9a-f]+);", 1)
        short = F.when(F.length(number) < 8, number)
        code = F.when(F.startswith(short, F.lit("x")), F.conv(F.substring(short, 2, 6), 16, 10)).otherwise(short).try_cast("int")
        known = code.between(0x20, 0xD7FF) | code.between(0xE000, 0xFFFD)
        sign = F.lower(F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 4, "0")), "UTF-16BE"))
        base = F.translate(sign, _MARKED, _UNMARKED)
        shown = F.when(base == sign, sign).otherwise(F.concat(base, F.lit("-")))
        rest = F.substr(part, F.instr(part, ";") + 1)
        return F.when(number != "", F.concat(F.coalesce(shown, F.lit("-")), rest)).otherwise(F.concat(F.lit("-"), part))

    parts = F.split(lowered, "&#")
    decoded = F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decode), "")
    return F.when(F.contains(lowered, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), decoded)).otherwise(lowered)


def slugify(text: Column | str) -> Column:
    s = F.replace(F.lower(col(text)), F.lit("'"), F.lit("-"))
    s = fold_letters(s)
    # An apostrophe that comes from a reference vanishes, unlike one that was written.
    s = F.replace(decode_references(s), F.lit("'"), F.lit(""))
    s = F.regexp_replace(s, "&(?:amp|lt|gt|quot);", "-")
    s = F.regexp_replace(s, "(?<=[0-9]),(?=[0-9])", "")
    s = F.btrim(F.regexp_replace(s, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.btrim(F.left(s, F.lit(SLUG_WIDTH)), F.lit("-"))


def carrier_slug(legal_name: Column | str, usdot: Column | str) -> Column:
    base = F.coalesce(F.nullif(slugify(legal_name), F.lit("")), F.lit("carrier"))
    return F.concat(base, F.lit("-usdot-"), col(usdot))


def dot_from_slug(slug: Column | str) -> Column:
    """The digits after the last `-usdot-`, null when there are none."""
    return F.nullif(F.regexp_extract(col(slug), "-usdot-([0-9]+)$", 1), F.lit(""))
