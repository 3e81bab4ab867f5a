"""Column expressions for entities: normal forms, ids, keys, dates and validators."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their ASCII forms, in the same order.
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

#: Letters of other alphabets and ligatures, and how they are romanised (lower case; a capital gives a capital).
ROMAN = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ı": "i",
    "ā": "a", "ă": "a", "ą": "a", "ć": "c", "č": "c", "ď": "d", "ē": "e", "ė": "e", "ę": "e", "ě": "e", "ğ": "g", "ģ": "g", "ī": "i", "į": "i", "ķ": "k",
    "ļ": "l", "ľ": "l", "ń": "n", "ň": "n", "ņ": "n", "ō": "o", "ő": "o", "ŕ": "r", "ř": "r", "ś": "s", "š": "s", "ş": "s", "ș": "s", "ť": "t", "ţ": "t", "ț": "t",
    "ū": "u", "ů": "u", "ű": "u", "ų": "u", "ź": "z", "ż": "z", "ž": "z",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "ά": "a", "έ": "e", "ή": "e", "ί": "i", "ό": "o", "ύ": "u", "ώ": "o", "ϊ": "i", "ϋ": "u",
}

#: Letters of right-to-left alphabets, some by signs that go with punctuation, and of Georgian.
ARABIC = {
    "آ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z",
    "غ": "g", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ؤ": "w", "ئ": "y", "پ": "p", "چ": "ch", "ژ": "zh", "ک": "k", "گ": "g", "ی": "y",
    "ء": "", "أ": "", "إ": "", "ا": "", "ة": "", "ع": "", "ى": "", "ـ": "",
}
HEBREW = {
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "ך": "k", "כ": "k", "ל": "l", "ם": "m", "מ": "m", "ן": "n", "נ": "n",
    "ס": "s", "ע": "", "ף": "p", "פ": "p", "ץ": "ts", "צ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
}
GEORGIAN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z", "თ": "t", "ი": "i", "კ": "k", "ლ": "l", "მ": "m", "ნ": "n", "ო": "o", "პ": "p", "ჟ": "zh", "რ": "r",
    "ს": "s", "ტ": "t", "უ": "u", "ფ": "p", "ქ": "k", "ღ": "gh", "ყ": "q", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}
#: The parts of a Hangul syllable, in the order of its arithmetic.
HANGUL = [
    ["g", "gg", "n", "d", "dd", "r", "m", "b", "bb", "s", "ss", "", "j", "jj", "c", "k", "t", "p", "h"],
    ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "weo", "we", "wi", "yu", "eu", "yi", "i"],
    ["", "g", "gg", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "c", "k", "t", "p", "h"],
]
#: Kana and signs whose sound isn't that of their Unicode name.
KANA, INDIC_SIGNS = {"si": "shi", "ti": "chi", "tu": "tsu"}, {"CANDRABINDU": "n", "ANUSVARA": "n", "BINDI": "n", "VISARGA": "h"}

#: Fixed values, applied in this order.
DEFANG = [
    ("[.]", "."), ("(dot)", "."), ("[dot]", "."), (" dot ", "."), (" (at) ", "@"), ("[at]", "@"), ("{at}", "@"), (" at ", "@"),
    ("arroba", "@"), ("hxxp://", "http://"), ("hxxps://", "https://"),
]

#: Other names of labels.
ALIAS = {
    "PHONE_INTL": "PHONE", "BTC": "CRYPTO_BTC_ADDRESS", "BITCOIN": "CRYPTO_BTC_ADDRESS", "BIC": "SWIFT_BIC", "SWIFT": "SWIFT_BIC",
    "GEO_DD": "GEOLOCATION_DD", "GEO_DMS": "GEOLOCATION_DMS",
}

#: Months by name.
SPANISH_MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
ENGLISH_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: Fixed value: control letters of Spanish identity numbers, by the number mod 23.
ID_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Least score by label, and for any other label.
THRESHOLDS = {"PER": 0.35, "ORG": 0.50, "LOC": 0.50, "DATE": 0.45, "MONEY": 0.55}
OTHER_THRESHOLD = 0.50


def _romans() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that give one letter, what they give, and the replacements of the others."""
    both = {k: v for low, v in ROMAN.items() for k, v in ((low, v), (low.upper(), v.capitalize())) if len(k) == 1}
    one = {k: v for k, v in both.items() if len(v) == 1}
    return FOLD_FROM + "".join(one), FOLD_TO + "".join(one.values()), [(k, v) for k, v in both.items() if len(v) != 1]


#: Ranges of code points that are romanised by a table; Hangul syllables are by arithmetic.
BLOCKS = [(0xA0, 0xE00), (0x10A0, 0x1100), (0x1E00, 0x2000), (0x3040, 0x3100), (0xFB00, 0xFB07), (0xFF00, 0xFFF0)]
_INDIC = re.compile(r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA) (LETTER|VOWEL SIGN|SIGN) (.+)")
_VOWEL = re.compile(r"A|AA|I|II|U|UU|E|EE|AI|O|OO|AU|(?:SHORT|CANDRA) [AEO]|VOCALIC [RL]+")
_KANA = re.compile(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?(\w+)")


def romanised(char: str) -> str:
    """A character in Latin letters: by the tables, by its digit, by the name that Unicode gives it or by what it is composed of; others stay."""
    known = {k: v for low, v in ROMAN.items() for k, v in ((low, v), (low.upper(), v.capitalize())) if len(k) == 1}
    known |= dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | ARABIC | HEBREW | GEORGIAN
    if char in known:
        return known[char]
    if unicodedata.category(char) == "Nd":
        return str(unicodedata.decimal(char))
    name = unicodedata.name(char, "")
    if m := _INDIC.match(name):
        kind, sound = m.groups()
        if kind == "SIGN":
            return INDIC_SIGNS.get(sound, "")
        plain = sound.split()[-1].lower()
        return plain if kind == "VOWEL SIGN" or _VOWEL.fullmatch(sound) else plain.removesuffix("a")
    if m := _KANA.match(name):
        return KANA.get(m[1].lower(), m[1].lower())
    if unicodedata.category(char) == "Mn":
        return ""
    parts = [x for x in unicodedata.normalize("NFKD", char) if unicodedata.category(x) != "Mn"]
    if parts != [char] and all(x.isascii() or x in known for x in parts):
        return "".join(known.get(x, x) for x in parts)
    return char


@functools.cache
def _tables() -> list[tuple[int, int, str]]:
    """(first, last code point, forms joined by line breaks) of each block."""
    return [(a, b - 1, "\n".join(romanised(chr(c)) for c in range(a, b))) for a, b in BLOCKS]


def _romanise(char: Column) -> Column:
    """One character by its place in its block's table, which is one constant array."""
    code = F.ascii(char)
    at = code - 0xAC00
    initial, vowel, final = (F.split(F.lit("\n".join(part)), "\n") for part in HANGUL)
    part = lambda table, k: F.element_at(table, (k + 1).cast("int"))
    syllable = F.concat(part(initial, F.floor(at / 588)), part(vowel, F.floor(at % 588 / 28)), part(final, at % 28))
    out = F.when(code < 0x80, char).when(code.between(0xAC00, 0xD7A3), syllable)
    for first, last, forms in _tables():
        out = out.when(code.between(first, last), F.element_at(F.split(F.lit(forms), "\n"), code - first + 1))
    return out.otherwise(char)


def fold(text: Column) -> Column:
    """ASCII for letters with marks and for the letters of most alphabets and syllabaries; Chinese characters and some rarer scripts stay."""
    foreign = lambda x: F.rlike(x, F.lit(r"[^\x00-\x7F]"))
    old, new, _ = _romans()
    letters = F.translate(text, old, new)  # letters that give one letter, in one pass; many names need no more
    folded = F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("(?s)."), F.lit(0)), _romanise), "")
    return F.when(foreign(text), F.when(foreign(letters), folded).otherwise(letters)).otherwise(text)


def normalize_entity(text: Column, keep_marks: bool = False) -> Column:
    """Folded letters, lower case, trimmed; punctuation goes unless keep_marks."""
    out = fold(text)
    if not keep_marks:
        out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.trim(F.lower(out))


def normalize_sql(text: str) -> str:
    """normalize_entity as DuckDB SQL."""
    old, new, others = _romans()
    out = f"translate({text}, '{old}', '{new}')"
    for a, b in others:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(lower(regexp_replace({out}, '[^\\pL\\pM\\pN_\\s]', '', 'g')))"


def entity_id(label: Column, text: Column) -> Column:
    """Twelve hex digits of the label and the normal form; a text of punctuation alone stands for itself."""
    norm = normalize_entity(text)
    name = F.when(norm == "", F.trim(text)).otherwise(norm)
    return F.substring(F.sha2(F.concat(label, F.lit(":"), name), 256), 1, 12)


def defang(text: Column) -> Column:
    for old, new in DEFANG:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _calendar(y: Column, m: Column, d: Column) -> Column:
    """DD/MM/YYYY if it is a day of 1900 to 2100, else null."""
    iso = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when((F.year(day) >= 1900) & (F.year(day) <= 2100), F.date_format(day, "dd/MM/yyyy"))


def normalize_date(text: Column) -> Column:
    """DD/MM/YYYY of a written date, or null: numeric forms are checked against the calendar, forms with month names by year and day range."""
    t = F.trim(text)
    spanish = {m: f"{k:02d}" for k, m in enumerate(SPANISH_MONTHS, 1)}
    english = {m: f"{k:02d}" for k, m in enumerate(ENGLISH_MONTHS, 1)}
    part = lambda p, k: F.regexp_extract(t, p, k)
    dmy, ymd = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"
    named, us, month_year = r"(?i)^(\d{1,2})\s+(?:de\s+)?(\w+)\s+(?:de\s+)?(\d{4})$", r"(?i)^(\w+)\s+(\d{1,2}),?\s+(\d{4})$", r"(?i)^(\w+)\s+(?:de\s+)?(\d{4})$"
    in_range = lambda y: F.try_to_number(y, F.lit("9999")).between(1900, 2100)
    by_name = F.coalesce(_lookup(spanish, F.lower(part(named, 2))), _lookup(english, F.lower(part(named, 2))))
    us_month = _lookup(english, F.lower(part(us, 1)))
    us_day = part(us, 2)
    any_month = F.coalesce(_lookup(spanish, F.lower(part(month_year, 1))), _lookup(english, F.lower(part(month_year, 1))))
    return (
        F.when(F.rlike(t, F.lit(dmy)), _calendar(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(F.rlike(t, F.lit(ymd)), _calendar(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(by_name.isNotNull(), F.concat(F.lpad(part(named, 1), 2, "0"), F.lit("/"), by_name, F.lit("/"), part(named, 3)))
        .when(
            us_month.isNotNull(),
            F.when(in_range(part(us, 3)) & F.try_to_number(us_day, F.lit("99")).between(1, 31), F.concat(F.lpad(us_day, 2, "0"), F.lit("/"), us_month, F.lit("/"), part(us, 3))),
        )
        .when(any_month.isNotNull(), F.when(in_range(part(month_year, 2)), F.concat(F.lit("01/"), any_month, F.lit("/"), part(month_year, 2))))
    )


def _mod97(iban: Column) -> Column:
    """ISO 7064 remainder of the rearranged number is 1; letters count as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    digit = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda acc, c: F.when(digit(c) < 10, acc * 10 + digit(c)).otherwise(acc * 100 + digit(c)) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _control_letter(digits: Column, letter: Column) -> Column:
    return F.substring(F.lit(ID_LETTERS), (digits.try_cast("int") % 23) + 1, F.lit(1)) == letter


def _degrees(segment: Column) -> Column:
    """Signed degrees of one degree-minute-second coordinate, or null."""
    p = r"(\d{1,3})\s*[°d]\s*(\d{1,2})\s*['’´m]\s*(\d{1,2}(?:\.\d+)?)\s*[\"”s]?\s*([NnSsEeWwOo])"
    part = lambda k: F.regexp_extract(segment, p, k)
    size = part(1).try_cast("double") + part(2).try_cast("double") / 60 + part(3).try_cast("double") / 3600
    return size * F.when(F.upper(part(4)).isin("S", "W", "O"), -1).otherwise(1)


def is_valid(label: Column, text: Column) -> Column:
    """Whether a labelled text passes its label's check; labels without a check are invalid."""
    name = F.upper(F.trim(label))
    name = F.coalesce(_lookup(ALIAS, name), name)
    raw = F.trim(text)
    norm = defang(raw)
    packed, packed_raw = F.upper(F.replace(norm, F.lit(" "), F.lit(""))), F.upper(F.replace(raw, F.lit(" "), F.lit("")))
    like = lambda c, p: F.rlike(c, F.lit(p))
    domain = F.regexp_extract(norm, r"^[^@]*@([\s\S]*)$", 1)
    digits = F.regexp_replace(raw, r"\D", "")
    plain = F.trim(F.regexp_replace(F.translate(norm, ",°", "  "), r"\s+", " "))
    lat, lon = F.split(plain, " ")[0].try_cast("double"), F.get(F.split(plain, " "), F.lit(1)).try_cast("double")
    dms = F.regexp_extract_all(norm, F.lit(r"\d{1,3}\s*[°d][^NnSsEeWwOo]*[NnSsEeWwOo]"), F.lit(0))
    dms_lat, dms_lon = _degrees(F.get(dms, F.lit(0))), _degrees(F.get(dms, F.lit(1)))
    nif = F.when(like(packed_raw, r"^[XYZ]\d{7}[A-Z]$"), F.concat(F.instr(F.lit("XYZ"), F.substring(packed_raw, 1, 1)) - 1, F.substring(packed_raw, 2, 7))).when(
        like(packed_raw, r"^\d{8}[A-Z]$"), F.substring(packed_raw, 1, 8)
    )
    checks = {
        "EMAIL": ~F.contains(norm, F.lit(" ")) & like(norm, r"^[^@]+@[\s\S]+$") & F.contains(domain, F.lit(".")) & ~F.startswith(domain, F.lit(".")) & ~F.endswith(domain, F.lit(".")),
        "PHONE": like(raw, r"^[0-9+ \-()]+$") & F.length(digits).between(7, 15),
        "URL": like(norm, r"^(?i:https?)://[^/?#\s]+"),
        "CREDIT_CARD": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "IBAN_ES": like(packed, r"^ES\d{22}$") & _mod97(packed),
        "IBAN_INTL": like(packed, r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & _mod97(packed),
        "DNI_ES": like(packed_raw, r"^\d{8}[A-Z]$") & _control_letter(F.substring(packed_raw, 1, 8), F.substring(packed_raw, 9, 1)),
        "NIF_ES": nif.isNotNull() & _control_letter(nif, F.substring(packed_raw, 9, 1)),
        "CIF_ES": like(packed_raw, r"^[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-HJ]$"),
        "VAT_ES": like(packed_raw, r"^ES[A-Z0-9]{9,12}$"),
        "CRYPTO_BTC_ADDRESS": like(raw, r"^[13][1-9A-HJ-NP-Za-km-z]{25,34}$"),
        "SWIFT_BIC": like(packed_raw, r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"),
        "LICENSE_PLATE_ES": like(packed_raw, r"^\d{4}[BCDFGHJKLMNPQRSTVWXYZ]{3}$"),
        "GEOLOCATION_DD": lat.between(-90, 90) & lon.between(-180, 180),
        "GEOLOCATION_DMS": dms_lat.between(-90, 90) & dms_lon.between(-180, 180),
    }
    out = F.lit(False)
    for one, check in reversed(checks.items()):
        out = F.when(name == one, F.coalesce(check, F.lit(False))).otherwise(out)
    return F.coalesce((raw != "") & out, F.lit(False))


def passes_threshold(label: Column, score: Column, override: float | None = None) -> Column:
    if override is not None:
        return score >= override
    return score >= F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), label), F.lit(OTHER_THRESHOLD))


def ascii_boundary(pattern: str, first: bool = False, last: bool = False) -> str:
    r"""The pattern with \b rewritten so that only ASCII letters, digits and '_' are word characters.

    first, last: whether a \b at that end stands beside a word character of the pattern, so that looking to one side is enough.
    """
    if first:
        pattern = re.sub(r"^(\(\?i\))?\\b", lambda m: (m[1] or "") + r"(?<!\w)", pattern)
    if last and pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?!\w)"
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def embedding_key(model: Column, text: Column) -> Column:
    return F.concat(F.lit("emb:"), F.sha2(F.concat(model, F.lit(":"), text), 256))


def facts_key(settings: Column, text: Column, source: Column) -> Column:
    return F.concat(F.lit("artifact:inference:"), settings, F.lit(":"), F.sha2(F.concat(text, F.lit(":"), source), 256))
