"""Text scalars as Column expressions: folding, river and locality keys, parsing, sanitising.

All run inside the JVM. :func:`fold_any` is the Arrow-batched form for scripts beyond Latin.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Letters of the old orthography and what they stand for.
LEGACY, MODERN = "şţŞŢåÅ", "șțȘȚâÂ"
# Leading generic words, trailing qualifiers, words that begin a free tail, and what a contract adds.
GENERIC = "raul rau paraul parau piriul piriu pr r fluviul canalul vl".split()
QUALIFIERS = "superior superioara superioare mijlociu mijlocie mijlocii inferior inferioara inferioare amonte aval i ii iii iv".split()
TAILS = "sector zona fara".split()
EXTRAS = "afluent parai revars".split()
CARDINALS = "est vest nord sud".split()
STEM_GENERIC = [*GENERIC, "valea", "izvorul", "garla", "paraiele", "canal"]
STEM_SUFFIXES = "ilor ului ul ei ii ua ea ia ie a e i u o".split()
# County codes and names.
COUNTIES = {
    "AB": "Alba", "AR": "Arad", "AG": "Argeș", "BC": "Bacău", "BH": "Bihor", "BN": "Bistrița-Năsăud", "BT": "Botoșani",
    "BV": "Brașov", "BR": "Brăila", "BZ": "Buzău", "CS": "Caraș-Severin", "CL": "Călărași", "CJ": "Cluj", "CT": "Constanța",
    "CV": "Covasna", "DB": "Dâmbovița", "DJ": "Dolj", "GL": "Galați", "GR": "Giurgiu", "GJ": "Gorj", "HR": "Harghita",
    "HD": "Hunedoara", "IL": "Ialomița", "IS": "Iași", "IF": "Ilfov", "MM": "Maramureș", "MH": "Mehedinți", "MS": "Mureș",
    "NT": "Neamț", "OT": "Olt", "PH": "Prahova", "SM": "Satu Mare", "SJ": "Sălaj", "SB": "Sibiu", "SV": "Suceava",
    "TR": "Teleorman", "TM": "Timiș", "TL": "Tulcea", "VS": "Vaslui", "VL": "Vâlcea", "VN": "Vrancea", "B": "București",
}


def _latin_marks() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and marks, and those letters."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _latin_marks()


def strip_marks(c: Column) -> Column:
    """Latin letters without their marks; loose combining marks go."""
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"\p{M}+", "")


def fix_diacritics(c: Column) -> Column:
    """Old orthography to new; case and punctuation stay; null is empty."""
    return F.translate(F.coalesce(c, F.lit("")), LEGACY, MODERN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without marks or punctuation but hyphens, blanks squeezed; idempotent; null is empty."""
    return squeeze(F.regexp_replace(strip_marks(F.lower(fix_diacritics(c))), r"(?U)[^\w\s-]|_", " "))


@pandas_udf(T.StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """:func:`fold` with full Unicode decomposition."""
    s = s.fillna("").str.translate(str.maketrans(LEGACY, MODERN)).str.lower().str.normalize("NFKD")
    s = s.map(lambda t: "".join(ch for ch in t if not unicodedata.combining(ch)))
    return s.str.replace(r"[^\w\s-]|_", " ", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _no_generic(c: Column) -> Column:
    return F.regexp_replace(c, rf"^(?:{_any(GENERIC)} )+(?=\S)", "")


def river_keys(c: Column) -> Column:
    """Match keys of a river name, most specific first, distinct; empty for no name."""
    s = _no_generic(fold(c))
    s = F.regexp_replace(s, rf"^(\S+(?: \S+)*?) (?:{_any(TAILS)}(?: .*)?|(?:cu|si) {_any(EXTRAS)}.*)$", "$1")
    s = F.regexp_replace(s, rf"^(\S+(?: \S+)*?)(?: {_any(QUALIFIERS)})+$", "$1")
    rest = _no_generic(F.regexp_replace(s, "^valea ", ""))
    base = F.when(~s.startswith("valea "), F.array(s)).when(rest.rlike(rf"^{_any(GENERIC)}$"), F.array(rest)).otherwise(F.array(F.concat(F.lit("valea "), rest), rest))
    both = F.flatten(F.transform(base, lambda k: F.array(k, F.regexp_replace(k, rf"^(\S+(?: \S+)*) de {_any(CARDINALS)}$", "$1"))))
    return F.array_distinct(F.filter(both, lambda k: k != ""))


def river_key(c: Column) -> Column:
    """The most specific key; empty if there is none."""
    return F.coalesce(F.get(river_keys(c), F.lit(0)), F.lit(""))


def article_variants(key: Column) -> Column:
    """Keys without the definite article or genitive of the last word."""
    cut = lambda n: F.substring(key, 1, F.length(key) - n)
    return F.when(key.rlike(r"(?:^| )\S+ului$") & (F.length(F.substring_index(key, " ", -1)) > 5), F.array(cut(3))).when(
        key.rlike(r"(?:^| )\S+ul$") & (F.length(F.substring_index(key, " ", -1)) > 4), F.array(cut(1), cut(2))
    ).otherwise(F.array().cast("array<string>"))


def river_match_keys(c: Column) -> Column:
    keys = river_keys(c)
    return F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, article_variants))))


def stem_key(c: Column) -> Column:
    """Words without inflection endings, each keeping three letters or more."""
    s = F.regexp_replace(squeeze(F.replace(fold(c), F.lit("-"), F.lit(" "))), rf"^(?:{_any(STEM_GENERIC)} )+(?=\S)", "")
    s = F.regexp_replace(s, rf"^(\S+(?: \S+)*?)(?: {_any(QUALIFIERS)})+$", "$1")
    return F.array_join(F.transform(F.split(s, " "), lambda t: F.regexp_replace(t, rf"^(.{{3,}}?){_any(STEM_SUFFIXES)}$", "$1")), " ")


def water_key(c: Column) -> Column:
    """First word of a name without marks, brackets and the leading kind of water."""
    s = F.trim(F.regexp_replace(strip_marks(F.lower(F.coalesce(c, F.lit("")))), r"\(.*?\)", " "))
    s = F.trim(F.regexp_replace(s, r"^(?:raul|rau|paraul|parau|valea|fluviul|lacul|balta|canalul)\s+", ""))
    return F.coalesce(F.get(F.split(s, r"[\s,/-]+"), F.lit(0)), F.lit(""))


def group_key(river_group: Column, name: Column) -> Column:
    """The river group, else the water key; groups are equal keys, exactly."""
    return F.coalesce(F.nullif(river_group, F.lit("")), water_key(name))


def same_river(a: Column, b: Column) -> Column:
    """Equal first five letters; empty is never the same."""
    x, y = F.left(water_key(a), F.lit(5)), F.left(water_key(b), F.lit(5))
    return (x != "") & (x == y)


def is_main_course(name: Column) -> Column:
    return ~name.rlike(r"(?iU)^(?:valea|paraul|parau|pârâu|pârâul)\s")


def course_rank(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("superior"), 0).when(n.contains("mijloci"), 1).when(n.contains("inferior"), 2).otherwise(3)


def locality_key(c: Column) -> Column:
    return strip_marks(F.lower(F.trim(c)))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(strip_marks(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def county_key(c: Column) -> Column:
    return F.regexp_replace(strip_marks(F.lower(fix_diacritics(c))), "[^a-z0-9]", "")


def canonical_county(c: Column) -> Column:
    """One of the county names if its key or code is known, else the text in title case."""
    known = {}
    for code, name in COUNTIES.items():
        plain = unicodedata.normalize("NFKD", name.lower())
        known["".join(ch for ch in plain if ch.isalnum() and ch.isascii())] = name
        if len(code) > 1:
            known[code.lower()] = name
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, county_key(c)), F.initcap(F.trim(c)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of distinct words; 0 if either is empty."""
    x, y = F.array_distinct(F.filter(F.split(a, " "), lambda t: t != "")), F.array_distinct(F.filter(F.split(b, " "), lambda t: t != ""))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)).cast("double") / most)


def first_token_ok(a: Column, b: Column) -> Column:
    """First words are equal, or one is the other with an article."""
    x, y = F.substring_index(a, " ", 1), F.substring_index(b, " ", 1)
    with_article = lambda p, q: (p == F.concat(q, F.lit("ul"))) | (p == F.concat(q, F.lit("l")))
    return (x == y) | with_article(x, y) | with_article(y, x)


@pandas_udf(T.DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null counts as empty."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def token_core_match(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other and a blank, or words overlap by 0.6 or more with two shared."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(x, y))
    return (a != "") & (b != "") & ((a == b) | a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" "))) | ((shared >= 2) & (token_overlap(a, b) >= 0.6)))


def road_ref_match(want: Column, have: Column) -> Column:
    """Equal but for blanks, hyphens and case, or one of them longer by one letter at the end; an empty reference matches nothing."""
    x, y = (F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s-]+", "")) for c in (want, have))
    longer = lambda a, b: a.startswith(b) & (F.length(a) == F.length(b) + 1) & a.rlike("[A-Z]$")
    return (x != "") & (y != "") & ((x == y) | longer(x, y) | longer(y, x))


def number(c: Column) -> Column:
    """A number with decimal comma or point."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_size(c: Column) -> Column:
    """'35 km' or '0,24 Ha' as struct(value, unit, raw); a dash or nothing is null."""
    s = F.trim(F.coalesce(c, F.lit("")))
    value = number(F.regexp_extract(s, r"^(\d+(?:[.,]\d+)?)", 1))
    unit = F.nullif(F.lower(F.regexp_extract(s, r"(?i)\b(km|ha)\b\.?$", 1)), F.lit(""))
    ok = s.rlike(r"^\d")
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, unit).alias("unit"), s.alias("raw"))


def first_measure(c: Column, unit: str) -> Column:
    """The first number before ``unit`` that is no tail of another number."""
    return number(F.nullif(F.regexp_extract(c, rf"(?i)(?<![\d.,])(\d+(?:[.,]\d+)?)\s*{unit}\b", 1), F.lit("")))


def contract_km(c: Column) -> Column:
    return first_measure(c, "km")


WATER_TYPES = [("^(?:lac|lacul|acumulare|acumularea|baraj)\\b", "lake"), ("^(?:balta|iaz|iazul|helesteu|elesteu)\\b", "pond"), ("^(?:rau|raul|fluviul|parau|paraul|valea|izvorul|garla)\\b", "river"), ("^(?:canal|canalul)\\b", "canal")]


def water_type(name: Column) -> Column:
    """Kind of water by its first word; other if none is known."""
    s, out = fold(name), F
    for pattern, kind in WATER_TYPES:
        out = out.when(s.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("other"))


def association_type(name: Column) -> Column:
    s = fold(name)
    return (
        F.when(s.rlike(r"^(?:ajvps|jvps)\b"), "ajvps")
        .when(s.rlike(r"\b(?:romsilva|directia silvica|ds)\b"), "romsilva")
        .when(s.rlike(r"^(?:as|asociatia|aps|avps|club|clubul)\b"), "association")
        .when(s.rlike(r"\bsrl\b|\bsa\b"), "company")
        .otherwise("other")
    )


def split_note(c: Column) -> Column:
    """'Name (note)' as struct(name, note)."""
    s = F.trim(F.coalesce(c, F.lit("")))
    note = F.nullif(F.trim(F.regexp_extract(s, r"\(([^()]*)\)\s*$", 1)), F.lit(""))
    return F.struct(F.trim(F.regexp_replace(s, r"\s*\([^()]*\)\s*$", "")).alias("name"), note.alias("note"))


def split_aliases(c: Column) -> Column:
    """'A (B, C)' as [A, B, C], distinct by folded form, first spelling kept."""
    parts = F.filter(F.transform(F.split(F.translate(F.coalesce(c, F.lit("")), "();/", ",,,,"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(parts, lambda x, i: F.array_position(F.transform(parts, fold), fold(x)) == i + 1)


def parent_code(code: Column) -> Column:
    """A cadastral code with its last level that isn't zero set to zero; null at the top."""
    up = F.regexp_replace(code, r"-0*[1-9]\d*((?:-0+)*)$", "-0$1")
    return F.when(up != code, up)


def name_flags(name: Column) -> Column:
    """Sorted flags of a name: letters of another script, old orthography."""
    flags = F.array(F.when(name.rlike(r"\p{IsCyrillic}|\p{IsGreek}"), "non_latin"), F.when(name.rlike(f"[{LEGACY}]"), "legacy_orthography"))
    return F.array_sort(F.array_compact(flags))


def phone_plausible(c: Column) -> Column:
    """A national number of ten digits, or one with the country code; blanks, dots and dashes don't count."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s().-]", "").rlike(r"^(?:\+?40|0)[237]\d{8}$")


PRIVATE_HOST = r"^(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.|0\.|\[?::1)"


def url_policy(c: Column) -> Column:
    """Why a URL is refused: empty, scheme, credentials, host, private_host, port; null if it is fine."""
    s = F.trim(F.coalesce(c, F.lit("")))
    host = F.lower(F.regexp_extract(s, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    port = F.regexp_extract(s, r"^[A-Za-z]+://(?:[^/@]*@)?[^/:?#]*:(\d+)", 1)
    return (
        F.when(s == "", "empty")
        .when(~s.rlike("(?i)^https?://"), "scheme")
        .when(s.rlike(r"^[A-Za-z]+://[^/]*@"), "credentials")
        .when(host == "", "host")
        .when(host.rlike(PRIVATE_HOST), "private_host")
        .when((port != "") & ~port.isin("80", "443"), "port")
    )


def sanitize_url(c: Column) -> Column:
    """A URL without user, fragment and the values of secret parameters."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"#.*$", ""), r"^([A-Za-z]+://)[^/@]*@", "$1")
    return F.regexp_replace(s, r"(?i)([?&](?:token|key|api_?key|password|secret|access_token|sig)=)[^&]*", "$1REDACTED")


def safe_link(c: Column) -> Column:
    """https, tel and mailto links; anything else is null."""
    s = F.trim(c)
    return F.when(s.rlike(r"(?i)^https://[^\s/@]+(?:/\S*)?$"), s).when(s.rlike(r"^tel:\+?[\d().\s-]+$"), s).when(s.rlike(r"(?i)^mailto:[^\s@]+@[^\s@]+$"), s)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def sanitize_name(c: Column, most: int = 120) -> Column:
    """Letters, digits and plain punctuation, squeezed, at most ``most`` characters."""
    return F.left(squeeze(F.regexp_replace(strip_control(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s.,'()/-]", "")), F.lit(most))


def fence(c: Column) -> Column:
    """Text in a code fence longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    ticks = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(ticks, F.lit("\n"), c, F.lit("\n"), ticks)


def escape_inline(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1")


def contains_folded(c: Column, query: str) -> Column:
    """Substring search without case and marks."""
    return fold(c).contains(fold(F.lit(query)))


def evidence_label(kind: Column, target: Column, county: Column) -> Column:
    """A line on where an endpoint comes from."""
    to = F.coalesce(target, F.lit("?"))
    return (
        F.when(kind == "SOURCE", "source")
        .when(kind == "MOUTH", "mouth")
        .when(kind == "COUNTY_LIMIT", F.concat(F.lit("limit of county "), F.coalesce(county, F.lit("?"))))
        .otherwise(F.concat_ws(" ", F.lower(F.replace(kind, F.lit("_"), F.lit(" "))), to))
    )


def ngrams(c: Column, most: int = 4) -> Column:
    """Word n-grams of a folded text, longest first, then leftmost, as struct(neg_n, at, gram)."""
    t = F.filter(F.split(fold(c), " "), lambda x: x != "")

    def of(n: int) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(-n).alias("neg_n"), i.alias("at"), F.array_join(F.slice(t, i + 1, n), " ").alias("gram")))

    return F.concat(*[of(n) for n in range(most, 0, -1)])
