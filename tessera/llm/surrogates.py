"""PII: keyed surrogates for detected entities, in DataFrame functions only.

Entities are e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, payment cards (in the groups that cards are
written in, Luhn-valid), social security numbers, account numbers (IBAN), secrets (access keys, hexadecimal tokens,
values of password-like keys), names after a title, and further mentions of such a name's parts in the same document.
Names that a document never writes after a title are not detected. A surrogate follows from the secret key and the
entity's canonical form alone, so an entity has one everywhere (coreference), in the same format: digits for digits,
letters for letters of the same script and case, the card's first digit and check digit rule, the address's form and
top-level domain, a given name of the same gender and script. The gender is the title's; after a title of either, that
with which the corpus writes the name elsewhere, else that of the lists below, else the surrogate fits both. Numbers
are mapped by a keyed Feistel permutation, which is one-to-one.

Distinctness is checked on the corpus's distinct entities: where two have one surrogate, or a surrogate is the
original of another, all but the first by code point take their next candidate, until none collide.

Cases: null texts stay null; texts of any length are scanned whole; of matches that overlap the first in the text
stands, of those at one place the first kind of ``PATTERNS``; a mention that is both a given name and a surname of its
document counts as the given name; repeated rows are rewritten alike; rows with a null id are rewritten too; the table
may be empty; further columns are kept as they are, whatever their names, but for ``n_entities``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, settle, unused, written

#: Candidates of an entity before the number of its letters grows.
ROUNDS = 12

_B = r"(?<![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GAP = r"[^\p{L}\p{N}\n]{1,5}"
# apostrophes and hyphens stand within a name; that of a genitive does not belong to it
_NAME = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?![sS](?!\p{L})))++"
_HEX = "[0-9A-Fa-f]{1,4}"
_MALE, _FEMALE = "Mr|Herr|Herrn|Monsieur|Señor|господин|Господин|κύριος|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|госпожа|Госпожа|κυρία|Κυρία"
# what has no bound of its own is matched to its end, in possessive steps: they neither go back nor need a stack; the
# others' bounds are those of their standards (for domains labels of 63 characters, 126 of them and a top one)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "key": _B + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{6,}+",
    "hex": _B + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}" + _GAP + r"[0-9]{2,4}" + _GAP + r"[0-9]{3,4}" + _GAP + r"[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[A-Fa-f:]*[0-9])(?:(?:" + _HEX + ":){7}" + _HEX + "|(?:" + _HEX + ":){1,6}(?::" + _HEX + r"){1,6})(?![\p{L}\p{N}:])",
    "name": _B + f"(?:{_MALE}|{_FEMALE}|Dr|Prof|Sr(?=\\.)|M(?=\\.))\\.? {_NAME}(?: {_NAME})*+",
    "han": r"[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗]\p{IsHan}{0,2}?(?=先生|女士|小姐)(?:先生|女士|小姐)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: How cards are written. They are looked for at every place, and those of a wrong check sum are no match that could
#: hide another; so they are not among the patterns, but added to them for a text, as they stand there.
CARDS = [r"[2-6][0-9]{12,18}", *(r"[2-6][0-9]{3}" + "".join(f"[ -][0-9]{{{n}}}" for n in groups) for groups in ((4, 4, 4), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (6, 5), (6, 4)))]
CARD_HINT = r"[0-9]{4}[ -]?[0-9]{4}[0-9]?[ -]?[0-9]"
#: Kinds whose entities may lack both digit and at sign (they all start a word, or are Han); every other kind holds one.
BARE = ("key", "secret", "hex", "name")
HINT = _B + "(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in BARE) + ")|" + PATTERNS["han"]

_ALPHABETS = [("0-9", "0123456789"), ("a-z", "abcdefghijklmnopqrstuvwxyz"), ("A-Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("а-яё", "абвгдежзиклмнопрстуфхцчшэюя"), ("А-ЯЁ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("ά-ώ", "αβγδεζηθικλμνξοπρστυφχψω"), ("Ά-Ώ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), ("ß-öø-ÿ", "äéíóúüñ"), ("À-ÖØ-Þ", "ÄÉÍÓÚÜÑ")]
_GIVEN = {
    ("latin", "m"): "Adam Anton Boris Bruno Carl Clemens Daniel David Emil Erik Felix Frank Georg Gustav Hector Hugo Ivan Jakob Jonas Karl Lars Leon Lukas Marco Martin Max Nils Oliver Oscar Paul Peter Ralf Robert Simon Stefan Theo Thomas Tom Victor Walter",
    ("latin", "f"): "Ada Agnes Alice Anna Bella Berta Carla Clara Diana Dora Edith Elena Emma Eva Flora Frida Greta Hanna Helen Ida Irene Iris Jana Julia Karin Laura Lea Lena Linda Lucy Maria Marta Mia Nina Nora Olga Paula Rosa Sara Vera",
    ("latin", "n"): "Alex Charlie Chris Dominique Eike Jo Kim Lou Maxime Noel Pat Robin Sam Sascha Toni",
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур Фёдор",
    ("cyrillic", "f"): "Алиса Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лидия Майя Мария Нина Ольга Полина Раиса София Юлия",
    ("cyrillic", "n"): "Валя Женя Паша Саша Слава Шура",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σταύρος Χρήστος",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία Χριστίνα",
}
_GIVEN["greek", "n"] = _GIVEN["greek", "m"] + " " + _GIVEN["greek", "f"]
_SURNAME = {
    "latin": "Abel Albers Arden Baker Barlow Becker Berg Blake Brandt Carver Castillo Conrad Dahl Dixon Duval Ebert Ellis Falk Ferrer Fischer Garner Gomez Graf Haas Hale Hartmann Iversen Jansen Keller Kramer Lang Larsen Lopez Marchand Mercer Moreau Nash Navarro Olsen Ortega Palmer Perrin Quinn Reyes Richter Roth Salas Sommer Stark Thorne Turner Ulrich Vance Vidal Weber Winter York Zeller",
    "cyrillic": "Белов Волков Громов Давыдов Ершов Жуков Зимин Калинин Лебедев Морозов Никитин Орлов Павлов Рябов Соколов Титов Ушаков Фомин Чернов Щукин",
    "greek": "Αγγέλου Βλάχου Γεωργίου Δήμου Ζήση Ιωάννου Κωνσταντίνου Λάμπρου Μακρή Νικολάου Οικονόμου Παππά Ράπτη Σωτηρίου Φωτίου",
}
_HAN = {"surname": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "m": "伟强磊军勇杰涛明超刚平辉鹏华飞", "f": "芳娜敏静丽艳娟霞玲婷雪琳倩梅兰"}


def _number(*of: Column | str | int) -> Column:
    """A keyed number below 2**60."""
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in of]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def _luhn(d: Column) -> Column:
    """The check sum of a digit string, its last digit counting once."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _permuted(d: Column, key: str, label: str, k: Column) -> Column:
    """A digit string (2 to 36 digits) mapped one-to-one to one of the same length."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")
    ten = lambda e: F.pow(F.lit(10.0), e).cast("long")
    left, right = F.substring(d, F.lit(1), a).cast("long"), F.substring(d, a + 1, n).cast("long")
    for r in range(3):
        left = (left + _number(key, label, k, n, r, "l", right) % ten(a)) % ten(a)
        right = (right + _number(key, label, k, n, r, "r", left) % ten(n - a)) % ten(n - a)
    return F.concat(F.lpad(left.cast("string"), a, "0"), F.lpad(right.cast("string"), n - a, "0"))


def _filled(m: Column, d: Column) -> Column:
    """The match with its digits replaced by those of ``d``, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda acc, c: F.struct(F.concat(acc["s"], F.when(c.rlike("[0-9]"), F.substring(d, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + c.rlike("[0-9]").cast("int")).alias("i"))
    return F.aggregate(F.split(m, ""), start, step, lambda acc: acc["s"])


def _letters(s: Column, key: str, label: Column, canon: Column, k: Column, hexadecimal: Column) -> Column:
    """Each character replaced by a keyed one of its class."""

    def one(c: Column, i: Column, form: Column) -> Column:
        use = F.when(hexadecimal & c.rlike("^[a-z]$"), "abcdef").when(hexadecimal & c.rlike("^[A-Z]$"), "ABCDEF")
        for span, alphabet in _ALPHABETS:
            use = use.when(c.rlike(f"^[{span}]$"), alphabet)
        at = (_number(key, label, form, k, i) % F.length(use) + 1).cast("int")
        return F.coalesce(F.substring(use, at, F.lit(1)), c)

    # each character hashes the form: of a long one its digest, made once, as the time would else grow with the square
    form = F.when(F.length(canon) > 256, F.sha2(canon, 256)).otherwise(canon)
    each = F.transform(F.array(form), lambda f: F.array_join(F.transform(F.split(s, ""), lambda c, i: one(c, i, f)), ""))
    return F.get(each, F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def cards(text: Column) -> Column:
    """The distinct cards of a text, the longest first."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?<![0-9])(?=({c})(?![0-9]))"), F.lit(1)) for c in CARDS)))
    valid = F.filter(F.array_distinct(found), lambda m: _luhn(_digits(m)) % 10 == 0)
    longest = F.transform(F.array_sort(F.transform(valid, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: x["m"])
    return F.when(text.rlike(CARD_HINT), longest).otherwise(F.array().cast("array<string>"))


def kind_of(m: Column) -> Column:
    """The kind of a whole match. A match ends where it ends: what follows it in the text is no longer there to look at."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = m.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.when(m.rlike("^[0-9 -]+$"), F.lit("card"))


_TITLE = f"^((?:{_MALE}|{_FEMALE}|Dr|Prof|Sr|M)\\.? )"


def _script(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def units(m: Column, kind: Column) -> Column:
    """``kind, canon``: what of a match has a surrogate of its own. Names are taken apart: the last token is the
    surname, the others are given names, so that a full name and the surname alone go together."""
    unit = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    tokens = F.split(F.regexp_replace(m, _TITLE, ""), " ")
    gender = F.when(m.rlike(f"^(?:{_FEMALE})[. ]"), "f").when(m.rlike("^(?:Dr|Prof)[. ]"), "n").otherwise("m")
    named = F.transform(tokens, lambda t, i: unit(F.when(i == F.size(tokens) - 1, F.concat(F.lit("surname-"), _script(t))).otherwise(F.concat(F.lit("given-"), _script(t), F.lit("-"), gender)), t))
    plain = (
        F.when(kind == "email", F.lower(m)).when(kind.isin("phone", "ssn", "card"), _digits(m)).when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "ip6", F.lower(m)).when(kind == "secret", F.regexp_extract(m, r"([A-Za-z0-9+/_.~-]{6,}+)$", 1)).otherwise(m)
    )
    return F.when(kind == "name", named).otherwise(F.array(unit(kind, plain)))


def candidates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (``kind, canon, k``) with ``new``: the ``k``-th candidate for an entity's canonical form."""
    kind, canon, k = F.col("kind"), F.col("canon"), F.col("k")
    n, at = F.length(canon), F.instr(canon, "@")
    domain = F.substring(canon, at + 1, n)
    top = F.regexp_extract(domain, r"(\.[a-z]+)$", 1)
    number = (
        F.when(kind == "card", F.substring(canon, F.lit(2), n - 2)).when(kind.isin("phone", "ssn") & (n > 10), F.substring(canon, n - 9, F.lit(10)))
        .when(kind.isin("phone", "ssn"), canon)
    )
    pool = None
    for name, names in [(f"given-{s}-{g}", p) for (s, g), p in _GIVEN.items()] + [(f"surname-{s}", p) for s, p in _SURNAME.items()]:
        pool = F.when(kind == name, names) if pool is None else pool.when(kind == name, names)
    staged = entities.withColumns({
        "_number": number, "_pool": F.split(pool, " "), "_head": F.regexp_extract(canon, r"^(AKIA|gh[pousr]_|sk-|[A-Z]{2}(?=[0-9]{2}))", 1),
        "_hex": kind.isin("hex", "ip6") | ((kind == "secret") & canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "_local": F.substring(canon, F.lit(1), at - 1),
        "_host": F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), "_domain": domain, "_top": top, "_octets": F.when(kind == "ip", F.transform(F.split(canon, r"\."), lambda x: x.try_cast("long"))),
    })
    octet = lambda i: F.get("_octets", F.lit(i))
    high, low = octet(0) * 256 + octet(1), octet(2) * 256 + octet(3)
    for r in range(3):
        high = (high + _number(key, "ip", k, r, "h", low)) % 65536
        low = (low + _number(key, "ip", k, r, "l", high)) % 65536
    no = F.lit(False)
    pick = lambda i: F.element_at("_pool", (_number(key, kind, canon, k, i) % F.size("_pool") + 1).cast("int"))
    # later candidates of a name join several of its pool; those of an address, which may be short, are longer
    named = F.when(k < 3, pick(0)).when(k < 8, F.concat_ws("-", pick(0), pick(1))).otherwise(F.concat_ws("-", pick(0), pick(1), pick(2), pick(3), F.when(k >= ROUNDS, F.initcap(F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), canon, k), 256), 1, 8), "0123456789", "ghijklmnop")))))
    longer = F.when(k >= ROUNDS, F.substring(F.sha2(F.concat_ws("|", F.lit(key), canon, k), 256), F.lit(1), F.least((k - ROUNDS + 2).cast("int"), F.lit(40)))).otherwise("")
    title = F.substring(canon, n - 1, F.lit(2))
    han = lambda pool, c, i: F.substring(F.lit(pool), (_number(key, "han", canon, k, i) % len(pool) + 1).cast("int"), F.lit(1))
    inner = F.filter(F.split(F.substring(canon, F.lit(2), n - 3), ""), lambda c: c != "")
    rest = F.transform(inner, lambda c, i: F.when(title == "先生", han(_HAN["m"], c, i)).otherwise(han(_HAN["f"], c, i)))
    first = F.substring(F.lit(_HAN["surname"]), (_number(key, "han", F.when(k < 3, F.substring(canon, 1, 1)).otherwise(canon), k) % len(_HAN["surname"]) + 1).cast("int"), F.lit(1))
    head = F.col("_head")
    lettered = (
        F.when(kind == "email", F.concat(_letters(F.col("_local"), key, F.lit("local"), canon, k, no), longer, F.lit("@"), _letters(F.col("_host"), key, F.lit("host"), F.col("_domain"), F.lit(0), no), F.col("_top")))
        .when(kind.isin("key", "iban", "hex", "secret", "ip6"), F.concat(F.when(kind.isin("key", "iban"), head).otherwise(""), _letters(F.when(kind.isin("key", "iban"), F.substring(canon, F.length(head) + 1, n)).otherwise(canon), key, kind, canon, k, F.col("_hex"))))
        .when(kind == "han", F.concat(first, F.array_join(rest, ""), title)).when(F.col("_pool").isNotNull(), F.when((kind == "surname-cyrillic") & canon.endswith("а"), F.concat(named, F.lit("а"))).otherwise(named))
    )
    staged = staged.withColumns({"_new": lettered, "_high": F.when(kind == "ip", high), "_low": F.when(kind == "ip", low), "_moved": F.when(F.col("_number").isNotNull(), _permuted(F.col("_number"), key, "number", k))})
    body = F.concat(F.substring(canon, F.lit(1), F.lit(1)), "_moved")
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    new = (
        F.when(kind == "card", F.concat(body, check)).when(F.col("_number").isNotNull(), F.concat(F.substring(canon, F.lit(1), n - F.length("_number")), "_moved"))
        .when(kind == "ip", F.concat_ws(".", *(x.cast("string") for x in (F.floor(F.col("_high") / 256), F.col("_high") % 256, F.floor(F.col("_low") / 256), F.col("_low") % 256)))).otherwise(F.col("_new"))
    )
    return staged.select(*entities.columns, new.alias("new"))


def _written(m: Column, kind: Column, news: Column) -> Column:
    """The match with the surrogates of its units, in its own format."""
    new = news[0]
    return (
        F.when(kind.isin("email", "ip6"), F.when(m.rlike("^[^a-z]*$"), F.upper(new)).otherwise(new))
        .when(kind == "name", F.concat(F.regexp_extract(m, _TITLE, 1), F.array_join(news, " ")))
        .when(kind.isin("phone", "ssn", "card"), _filled(m, new))
        .when(kind == "secret", F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(new)), new))
        .when((kind == "iban") & m.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 ")))
        .otherwise(new)
    )


def _found(text: Column) -> Column:
    """All matches of a text, in order; texts without a digit, an at sign or an entity that needs neither are passed by."""
    return F.when(text.rlike("[0-9@]") | text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pattern(numbers: Column, mentions: Column) -> Column:
    """The pattern for one text: all kinds, its cards, and the parts of its names."""
    also = lambda of, before, after: F.when(F.size(of) > 0, F.concat(F.lit(f"|{before}(?:"), F.array_join(of, "|"), F.lit(f"){after}"))).otherwise("")
    return F.concat(F.lit(PATTERN), also(numbers, "(?<![0-9])", "(?![0-9])"), also(mentions, _B + r"(?<![\p{L}\p{N}]-)", r"(?!-?[\p{L}\p{N}])"))


def genders(parts: DataFrame) -> DataFrame:
    """``parts`` with the kind of given names after a title of either gender: as elsewhere in the corpus, if it is one
    there, else as in the lists."""
    either = F.col("kind").startswith("given-") & F.col("kind").endswith("-n")
    known = parts.where(F.col("kind").startswith("given-") & ~either).groupBy("canon").agg(F.min("kind").alias("one"), F.max("kind").alias("other")).where("one = other").select("canon", F.col("one").alias("known"))
    listed = None
    for (script, gender), names in _GIVEN.items():
        if gender != "n":
            test, kind = F.col("canon").isin(*names.split()), F.lit(f"given-{script}-{gender}")
            listed = F.when(test, kind) if listed is None else listed.when(test, kind)
    out = parts.join(known, "canon", "left").withColumn("kind", F.when(either, F.coalesce("known", listed, "kind")).otherwise(F.col("kind")))
    return out.select(*parts.columns)


def resolve(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, new``: a surrogate of its own for each of the entities (distinct ``kind, canon``)."""
    state = keep(candidates(entities.withColumn("k", F.lit(0)), key), "surrogates")
    originals = entities.select("kind", F.col("canon").alias("new"))
    while True:
        taken = state.groupBy("kind", "new").agg(F.min(F.struct("k", "canon")).alias("first"), F.count("*").alias("n"))
        twice = taken.where("n > 1").select("kind", "new", F.col("first.canon").alias("owner"))
        clash = state.join(twice, ["kind", "new"]).where("canon <> owner").select("kind", "canon")
        clash = clash.unionByName(state.join(originals, ["kind", "new"], "left_semi").select("kind", "canon")).distinct()
        clash = keep(clash, "clashes")
        if not clash.limit(1).count():
            return state.select("kind", "canon", "new")
        again = state.join(clash, ["kind", "canon"]).select("kind", "canon", (F.col("k") + 1).alias("k"))
        state = keep(state.join(clash, ["kind", "canon"], "left_anti").unionByName(candidates(again, key)), "surrogates")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities`` added.

    What is written for a match is worked out once for each distinct match; a text gets the map of its own matches.
    """
    since = written(docs.sparkSession)
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.select("doc_id", F.xxhash64("text").alias("h"), F.array_distinct(_found(F.col("text"))).alias("ms"), cards(F.col("text")).alias("cards"))
    found = keep(found.where((F.size("ms") > 0) | (F.size("cards") > 0)).dropDuplicates(["doc_id", "h"]), "found")
    seen = found.select("doc_id", "h", F.explode(F.array_distinct(F.concat("ms", "cards"))).alias("m"))
    kinds = keep(seen.select("m").distinct().withColumn("kind", kind_of(F.col("m"))).where("kind is not null"), "kinds")
    parts = kinds.select("m", "kind", F.posexplode(units(F.col("m"), F.col("kind"))).alias("i", "u")).select("m", F.col("kind").alias("whole"), "i", "u.kind", "u.canon")
    parts = keep(genders(keep(parts, "units")), "gendered")
    new = resolve(parts.select("kind", "canon").distinct(), key)
    known = keep(parts.join(new, ["kind", "canon"]), "known")
    news = known.groupBy("m", "whole").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("news"))  # the tokens of one match
    whole = news.select("m", _written(F.col("m"), F.col("whole"), F.col("news")).alias("written"), F.lit(None).cast("string").alias("kind"), F.col("m").alias("of"))
    alone = known.where("whole = 'name'").select(F.col("canon").alias("m"), F.col("new").alias("written"), "kind", F.col("m").alias("of"))
    texts = seen.withColumnRenamed("m", "of").join(keep(whole.unionByName(alone), "written"), "of")
    # of one text: what is written for its matches; a mention has one kind there
    texts = texts.groupBy("doc_id", "h", "m").agg(F.min(F.struct("kind", "written")).alias("w"))
    maps = texts.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("m", "w.written"))).alias("new"), F.collect_list(F.when(F.col("w.kind").isNotNull(), F.col("m"))).alias("mentions"))
    numbers = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "cards")
    maps = maps.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "new", "cards", "mentions")
    docs = docs.drop("n_entities")
    d, h, new, numbers, mentions, pattern, matches = unused(docs, "of", "hash", "new", "numbers", "mentions", "pattern", "matches")
    held = settle(maps.toDF(d, h, new, numbers, mentions), "held", since)
    text, new_of = F.col("text").cast("string"), F.col(new)
    # by shuffle at every size: the maps grow with the documents
    out = docs.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    out = out.withColumn(pattern, F.when(new_of.isNotNull(), _pattern(F.col(numbers), F.col(mentions))))
    out = out.withColumn(matches, F.when(new_of.isNotNull(), F.regexp_extract_all(text, F.col(pattern), F.lit(0))))
    pieces = F.zip_with(F.split(text, F.col(pattern), F.lit(-1)), F.transform(matches, lambda m: F.coalesce(F.element_at(new_of, m), m)), lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    columns = [F.when(new_of.isNotNull(), F.array_join(pieces, "")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    count = F.when(new_of.isNull(), 0).otherwise(F.size(F.filter(matches, lambda m: F.element_at(new_of, m).isNotNull())))
    return out.select(*columns, count.cast("long").alias("n_entities"))
