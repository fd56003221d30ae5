"""PII surrogates: detected entities get keyed, type-consistent replacements, with DataFrame operations only.

1. One regular expression finds entities; ``regexp_extract_all`` gives them and ``split`` the text
   between, so that a text is put together again from both.
2. An entity becomes pieces: a literal prefix and a body with a type and a normal form (an e-mail
   address in lower case, a number's digits, a name's words one by one). The normal form carries
   coreference: one person or address has one surrogate wherever and however it is written.
3. Distinct bodies of the whole corpus get surrogates drawn from SHA-256 of a key, the type, the
   normal form and an attempt number. A surrogate that two bodies share, or that is itself a body
   of the corpus, is drawn again for the later one until none is left: distinct stays distinct, and no surrogate
   points at somebody real in the corpus.
4. Surrogates are joined back to the pieces and poured into the written form: punctuation, case,
   grouping and length of numbers stay.

Kinds: e-mail (an address under example.com/.org/.net), telephone, IPv4, card (first digit kept,
valid check digit), social security number, IBAN (valid check digits), access key, secret value (hexadecimal stays so), IPv6 (an address
under 2001:db8), and names after a form of address, and full ones without it in a text that has them with it: given names keep the gender that
a form of address states anywhere in the corpus, name parts their script (Latin, Cyrillic, Greek and those of the letters below).

Skew: an entity that a third of all documents hold is one row of the table of distinct bodies (map-side
combination), and the join back can split it. Texts are shuffled once, to meet their replaced pieces.

A secret's letters are drawn from their script and case (accented Latin, Cyrillic, Greek, Arabic, Hebrew, kana, Han, Hangul; others become
small Latin letters), its digits from digits; its other characters stay, unless it has nothing else (``********``): then symbols are drawn.

Defined cases: a null text stays null with 0 entities, an empty one empty; a null doc_id is a value
like any other; repeated rows, and rows without doc_id, get their texts' own results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import id_text
from gleaner.session import cut

SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
MALE, FEMALE, OPEN = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа", "Dr|Prof"
#: A word with a capital, or a short one in letters without case (in scripts that don't part words, a longer run is no name).
NAME_WORD = r"(?:\p{Lu}[\p{L}'’-]++|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,4}+(?!\p{L})|[\p{IsArabic}\p{IsHebrew}\p{IsHangul}]{1,15}+(?!\p{L}))"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind -> pattern, in order of precedence. Open-ended quantifiers are possessive: linear time on any text, and no rest of an entity stays.
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9]){SECRET_NAME}[^\s\"',;]{{6,}}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ip6": rf"(?<![:.\w])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![:.\w])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}(?![\d-])",
    "hex": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{OPEN})\.? {NAME_WORD}(?: {NAME_WORD})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A titled name of two words or more: the words are its last group.
FULL_NAME = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{OPEN})\.? ({NAME_WORD}(?: {NAME_WORD})++)"
LATIN = ["ba", "ce", "di", "fo", "ga", "he", "ki", "lo", "ma", "ne", "pi", "ro", "sa", "te", "vi", "zo"]
GREEK = ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ψο"]
CYRILLIC = ["ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "фи", "хо"]


def pattern_of(text: Column) -> Column:
    """What finds the entities of a text: the patterns above and, without a title, the full names that the text has with one."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(FULL_NAME), F.lit(1)))
    own = F.concat(F.lit(rf"{ANY}|(?<!\p{{L}})(?:\Q"), F.array_join(F.sort_array(names, False), r"\E|\Q"), F.lit(r"\E)(?![\p{L}'’-])"))  # of names that begin alike the longer first
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, own).otherwise(ANY)


def kind_of(entity: Column) -> Column:
    """The kind whose pattern the whole entity is; a name without its title is none of them."""
    found = None
    for kind, pattern in PATTERNS.items():
        test = entity.rlike(f"^(?:{pattern})$")
        found = F.when(test, kind) if found is None else found.when(test, kind)
    return found.otherwise("untitled")


def pieces_of(entity: Column, kind: Column) -> Column:
    """array<struct<kind, prefix, body, norm>>: what of an entity is replaced, and what stands before."""
    def piece(kind: Column, prefix: Column, body: Column, norm: Column) -> Column:
        return F.struct(kind.alias("kind"), prefix.alias("prefix"), body.alias("body"), norm.alias("norm"))

    none = F.lit("")
    prefix = F.regexp_extract(entity, f"^{SECRET_NAME}", 0)
    value = F.substring(entity, F.length(prefix) + 1, F.length(entity))
    words = F.split(entity, " ")
    gender = F.when(words[0].rlike(f"^(?:{MALE})\\.?$"), "given_m").when(words[0].rlike(f"^(?:{FEMALE})\\.?$"), "given_f").otherwise("given")
    last = F.size(words)
    names = F.transform(F.slice(words, 2, last), lambda w, i: piece(F.when(i == last - 2, "surname").otherwise(gender), F.lit(" "), w, F.lower(w)))
    untitled = F.transform(words, lambda w, i: piece(F.when(i == last - 1, "surname").otherwise("given"), F.when(i == 0, "").otherwise(" "), w, F.lower(w)))
    compact = F.regexp_replace(entity, r"[^A-Za-z0-9+]", "")
    return (
        F.when(kind == "secret", F.array(piece(F.lit("secret"), prefix, value, value)))
        .when(kind == "name", F.concat(F.array(piece(F.lit(None).cast("string"), words[0], none, none)), names))
        .when(kind == "untitled", untitled)
        .when(kind.isin("email", "ip6"), F.array(piece(kind, none, entity, F.lower(entity))))
        .when(kind.isin("phone", "ssn", "card", "iban"), F.array(piece(kind, none, entity, compact)))
        .otherwise(F.array(piece(kind, none, entity, entity)))
    )


#: Letters that take the place of letters of their script and case (of a script without a list: small Latin letters).
ALPHABETS = {
    "[0-9]": "0123456789",
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    r"\p{IsLatin}": "àáâãäåçèéêëìíîïñòóôõöùúûüý",
    r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{IsArmenian}&&\p{Lu}]": "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՓՔՕՖ",
    r"\p{IsArmenian}": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
    r"\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    r"\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    r"\p{IsHan}": "一丁七上下中久之五人今元入八公六共力十千口右四土大天女子小山川工左市年文方日月木本水火王田石立竹米羊見言足車金門青音",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하거너더러머버서어저처",
    r"\p{L}": "abcdefghijklmnopqrstuvwxyz",
}
SYMBOLS = "!#$%&*+-./:=?@^_~"
DRAWN = r"[0-9\p{L}]"
NAMES = ("given", "given_m", "given_f", "surname")


def _draw(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """array<int>: at least 16 keyed bytes, and one for each character of the normal form."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("\u0000", F.lit(key), kind, norm, attempt.cast("string"), b.cast("string")), 256))
    return F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.conv(F.substring(x, i, F.lit(2)), 16, 10).cast("int"))))


def _pick(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at % len(alphabet) + 1, F.lit(1))


def _swapped(c: Column, r: Column) -> Column:
    out = None
    for pattern, letters in ALPHABETS.items():
        test = c.rlike(pattern)
        out = F.when(test, _pick(letters, r)) if out is None else out.when(test, _pick(letters, r))
    return out.otherwise(c)


def _mod97(text: Column) -> Column:
    """The remainder of a number whose digits are A = 10 to Z = 35 and 0 to 9."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97))


def with_core(bodies: DataFrame, key: str) -> DataFrame:
    """``bodies`` (kind, norm, attempt) with ``core``, the surrogate of that attempt.

    Draws are columns of their own, so that each is made once for a row and not once for each use. With more attempts a
    surrogate grows, so that no form runs out: secrets, keys and addresses from the fifth on, numbers from the ninth.
    """
    kind, norm, attempt, raw, same, digits = (F.col(c) for c in ("kind", "norm", "attempt", "raw", "same", "digits"))
    bodies = bodies.withColumn("raw", _draw(key, kind, norm, attempt))
    each = F.slice(raw, F.lit(1), F.length(norm))
    swapped = F.array_join(F.zip_with(F.split(norm, ""), each, _swapped), "")
    hexed = F.array_join(F.transform(each, lambda r: _pick("0123456789abcdef", r)), "")
    signs = F.array_join(F.transform(each, lambda r: _pick(SYMBOLS, r)), "")
    drawn = F.when(norm.rlike("^(?=.*[a-f])[0-9a-f]++$"), hexed).when(norm.rlike(DRAWN), swapped).otherwise(signs)
    numbers = F.array_join(F.transform(each, lambda r: _pick("0123456789", r)), "")
    more = F.array_join(F.transform(F.slice(raw, F.lit(1), F.greatest(attempt - 4, F.lit(0))), lambda r: _pick("0123456789abcdef", r)), "")
    foreign = kind.isin(*NAMES) & ~norm.rlike(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]")
    longer = F.array_join(F.transform(F.slice(raw, F.lit(2), F.greatest(attempt - 4, F.lit(0))), lambda r: _swapped(F.right(norm, F.lit(1)), r)), "")
    bodies = bodies.withColumns({"same": F.when(kind.isin("secret", "hex", "email", "key", "iban"), drawn).when(foreign, F.concat(swapped, longer)), "digits": F.when(kind.isin("phone", "ssn", "card"), numbers), "more": F.substring(more, 1, 12)})
    return bodies.withColumn("core", _core(kind, norm, attempt, raw, same, digits, F.col("more"))).drop("raw", "same", "digits", "more")


def _core(kind: Column, norm: Column, attempt: Column, raw: Column, same: Column, digits: Column, more: Column) -> Column:
    """The core of a surrogate: what takes the place of a normal form."""
    grown = F.translate(F.when(attempt > 8, more).otherwise(""), "abcdef", "012345")  # digits that a number gains
    first = (F.get(raw, F.lit(15)) % 9 + 1).cast("string")
    local, domain, tld = F.substring_index(same, "@", 1), F.substring_index(same, "@", -1), F.substring_index(norm, ".", -1)
    email = F.concat(local, more, F.lit("@"), F.regexp_replace(domain, r"[^.]+\.[^.]+$", ""), F.lit("example."), F.when(tld.isin("com", "org", "net"), tld).otherwise("com"))
    plus = F.when(F.substring(norm, 1, 1) == "+", 1).otherwise(0)
    phone = F.concat(F.substring(norm, F.lit(1), 1 + plus), F.when(F.length(norm) > 1 + plus, first).otherwise(""), F.substring(digits, 3 + plus, F.length(norm)))
    phone = F.when(plus == 1, phone).otherwise(F.concat(first, F.substring(digits, F.lit(2), F.length(norm))))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get(raw, i) % 254 + 1).cast("string")), ".")
    ip = F.when(attempt > 20, F.concat(F.lit("2001:db8::"), more)).otherwise(ip)  # more addresses than the form has
    stem = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), F.length(norm) - 2), grown)
    n = F.length(stem)
    total = F.aggregate(F.split(stem, ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), lambda a, c: F.struct((a["i"] + 1).alias("i"), (a["s"] + F.when((n - a["i"]) % 2 == 1, _doubled(c.cast("int"))).otherwise(c.cast("int"))).alias("s")))["s"]
    card = F.concat(stem, ((10 - total % 10) % 10).cast("string"))
    country, account = F.substring(norm, 1, 2), F.concat(F.substring(same, F.lit(5), F.length(norm)), F.translate(F.when(attempt > 8, more).otherwise(""), "abcdef", "ABCDEF"))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    ip6 = F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit(":"), F.lower(F.hex(F.get(raw, 2 * i) * 256 + F.get(raw, 2 * i + 1))))), ""))
    cyrillic, greek = norm.rlike(r"\p{IsCyrillic}"), norm.rlike(r"\p{IsGreek}")
    size = F.least(F.lit(12), 4 + attempt)

    def syllables(parts: list[str]) -> Column:
        sounds = F.array(*map(F.lit, parts))
        return F.array_join(F.transform(F.slice(raw, F.lit(1), size), lambda r: F.get(sounds, r % 16)), "")

    end = {"given_m": ("n", "н", "νος"), "given_f": ("na", "на", "να"), "given": ("l", "ль", "ιλ"), "surname": ("r", "р", "ρης")}
    stem_of_name = F.when(cyrillic, syllables(CYRILLIC)).when(greek, syllables(GREEK)).otherwise(syllables(LATIN))
    name = None
    for k, (latin, slav, hellenic) in end.items():
        value = F.when(same.isNotNull(), F.initcap(same)).otherwise(F.initcap(F.concat(stem_of_name, F.when(cyrillic, slav).when(greek, hellenic).otherwise(latin))))
        name = F.when(kind == k, value) if name is None else name.when(kind == k, value)
    return (
        F.when(kind == "email", email).when(kind == "phone", F.concat(phone, grown)).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, F.lit(2), F.length(norm)), grown))
        .when(kind == "key", F.concat(F.substring(norm, 1, 4), F.upper(F.substring(same, F.lit(5), F.length(norm))), F.upper(more)))
        .when(kind == "iban", iban)
        .when(kind.isin(*end), name).otherwise(F.concat(same, more))
    )


def _doubled(d: Column) -> Column:
    return F.when(d > 4, 2 * d - 9).otherwise(2 * d)


def poured(kind: Column, body: Column, core: Column) -> Column:
    """A surrogate's core in the written form of the body; what the core has more comes last."""
    bare = F.regexp_replace(core, "[^A-Za-z0-9]", "")
    filled = F.aggregate(
        F.split(body, ""), F.struct(F.lit(1).alias("next"), F.lit("").alias("out")),
        lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct((a["next"] + 1).alias("next"), F.concat(a["out"], F.substring(bare, a["next"], F.lit(1))).alias("out"))).otherwise(F.struct(a["next"].alias("next"), F.concat(a["out"], c).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(bare, a["next"], F.length(bare))),
    )
    shouted = (F.length(body) > 1) & (body == F.upper(body)) & (body != F.lower(body))
    return F.when(kind.isin("phone", "ssn", "card", "iban"), filled).when(kind.isin("email", "given", "given_m", "given_f", "surname") & shouted, F.upper(core)).otherwise(core)


def one_gender(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the distinct bodies that get surrogates, (norm, as_kind) of the others): a given name without a stated gender goes with the same name where one is stated.

    So the Dr., the Mr. and the untitled of one name agree all over the corpus; where both genders are stated, it goes with the male one.
    """
    bodies = cut(bodies.distinct(), "surrogate-bodies")
    stated = bodies.filter("kind IN ('given_m', 'given_f')").groupBy("norm").agg(F.max("kind").alias("as_kind"))
    open_ = bodies.filter("kind = 'given'").join(stated, "norm").select("norm", "as_kind")
    rest = bodies.join(open_.select(F.lit("given").alias("kind"), "norm"), ["kind", "norm"], "left_anti")
    return rest, open_


def surrogate_table(bodies: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core) of distinct (kind, norm), no two of a kind with one core and none that is itself a norm.

    Only entities whose surrogate clashes are drawn again, each at its own next attempt; surrogates grow, so the rounds end.
    """
    attempt = F.col("attempt")
    # few bytes but much work a row, so the number of parts is given; of a hash, as ``distinct`` has dealt by the columns already
    n = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = bodies.distinct().repartition(n, F.xxhash64("kind", "norm")).withColumn("attempt", F.lit(0))
    table = cut(with_core(spread, key), "surrogates")
    real = table.select("kind", F.when(F.col("kind").isin(*NAMES), F.initcap("norm")).otherwise(F.col("norm")).alias("core")).distinct()
    real = cut(real, "surrogate-norms")
    while True:
        shared = table.groupBy("kind", "core").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "norm")).alias("keep")).filter("n > 1")
        clash = table.join(shared.select("kind", "core", "keep"), ["kind", "core"]).filter(F.struct("attempt", "norm") != F.col("keep")).select("kind", "norm")
        taken = table.join(real, ["kind", "core"], "left_semi").select("kind", "norm")
        again = cut(clash.unionByName(taken).distinct(), "surrogate-clashes")
        if again.isEmpty():
            return table.select("kind", "norm", "core")
        fresh = with_core(table.join(again, ["kind", "norm"], "left_semi").select("kind", "norm", (attempt + 1).alias("attempt")).repartition(n, F.xxhash64("kind", "norm")), key)
        table = cut(table.join(again, ["kind", "norm"], "left_anti").unionByName(fresh.select(*table.columns)), "surrogates")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, kinds (distinct, sorted, comma-joined) and the text with surrogates."""
    docs = id_text(docs).withColumn("version", F.xxhash64("text"))
    found = docs.select("doc_id", "version", F.posexplode(F.regexp_extract_all("text", pattern_of(F.col("text")), F.lit(0))).alias("pos", "entity"))
    found = found.withColumn("what", kind_of(F.col("entity")))
    pieces = found.select("doc_id", "version", "pos", "what", F.posexplode(pieces_of(F.col("entity"), F.col("what"))).alias("k", "p")).select("doc_id", "version", "pos", "k", "what", "p.*")
    pieces = cut(pieces, "pii-pieces")
    bodies, open_ = one_gender(pieces.filter("kind IS NOT NULL").select("kind", "norm"))
    core = surrogate_table(bodies, key)
    core = core.unionByName(open_.join(core, (F.col("as_kind") == core["kind"]) & (open_["norm"] == core["norm"])).select(F.lit("given").alias("kind"), open_["norm"], "core"))
    out = F.concat("prefix", F.when(F.col("kind").isNull(), F.col("body")).otherwise(poured(F.col("kind"), F.col("body"), F.col("core"))))
    met = pieces.join(core, ["kind", "norm"], "left").withColumnsRenamed({"doc_id": "p_id", "version": "p_version"})
    met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_id", "p_version")
    replaced = met.select("p_id", "p_version", "what", F.struct("pos", "k", out.alias("out")).alias("p"))
    replaced = replaced.groupBy("p_id", "p_version").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("what") == "untitled", "name").otherwise(F.col("what")))), ",").alias("kinds"))
    joined = docs.join(replaced, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("version") == F.col("p_version")), "left")
    gaps = F.split("text", pattern_of(F.col("text")), -1)
    text = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(F.when(p["k"] == 0, F.get("gaps", p["pos"])).otherwise(""), p["out"])), ""), F.element_at("gaps", -1))
    rows = joined.withColumn("gaps", F.when(F.col("ps").isNotNull(), gaps))
    n = F.coalesce(F.size(F.filter("ps", lambda p: p["k"] == 0)), F.lit(0))
    return rows.select("doc_id", n.cast("long").alias("n_entities"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.when(F.col("ps").isNull(), F.col("text")).otherwise(text).alias("text"))
