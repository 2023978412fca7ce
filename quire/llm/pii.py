"""Keyed surrogates for personal data and secrets; DataFrame functions only.

Detected: e-mail addresses, phone numbers, IPv4 addresses, card numbers, social security numbers, IBANs, quoted secrets and
names after a title. Each entity is replaced by a surrogate of its own type that keeps its format: separators, length, letter
case and script stay, a card keeps a valid check digit, an IBAN valid check digits (numbers that fail the check are none), an address has octets of the
same width, an e-mail keeps its top level, a phone its country code, and a name its title, gender and script. A phone written
without a country code is taken for one of country 1, so that both ways of writing it are one entity.

A surrogate is a function of a secret key, the type, the entity's canonical form and an attempt number, so that the same entity
has the same surrogate everywhere without any join (coreference). Over the distinct entities alone, collisions are then looked
for: a surrogate that two entities share, or that is itself an entity of the corpus, moves to the next attempt until none is
left (distinctness). A person's gender is what all titles of the name tell together: if "Mr" and "Dr" stand before one name,
both mentions get the same male surrogate; if titles contradict each other, a neutral one. Only entities with an attempt above 0
or with titles that differ in gender have to be looked up: as one broadcast map within `broadcast_rows`, beyond it by a join of
the texts that hold such an entity.

Defined cases: null stays null, text without an entity stays as it is; equal texts become equal texts; repeated rows are
replaced each for itself. `replaced` writes over the text column and adds `n_entities` (replacing a column of that name).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

_L = r"\p{L}\p{N}._%+'-"
_TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа", "г-жа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_TITLE = "|".join(t for ts in _TITLES.values() for t in sorted(ts, key=len, reverse=True))
#: A phone ends before an address or another dotted number; the freer form is for numbers that have dots themselves.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_AREA = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?"
_GROUP = rf"(?! (?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))[ .-]?\d{{2,4}}"
PATTERNS = {
    "email": rf"(?<![{_L}])[{_L}]++@(?:[\p{{L}}\p{{N}}-]++\.)+\p{{L}}{{2,24}}",
    "secret": r"""(?<=["'])(?<=(?i:token|secret|passwd|password|api_key|apikey|api-key)\s{0,3}[=:]\s{0,3}["'])[A-Za-z0-9+/_=.-]{8,512}+(?=["'])""",
    "ip": r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "phone": rf"(?<![\p{{L}}\d+])(?:\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}(?![\d-])|{_AREA}(?:{_GROUP}){{2}}(?:(?! \d{{1,4}}\.\d){_GROUP}){{0,2}}(?![\d-])|{_AREA}(?:[ .-]?\d{{2,4}}){{2,4}}|" r"\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\g\d{4}\g\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d\p{L}])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2} ?(?:[A-Z]{4}|\d{4})(?: ?\d{4}){2,6}(?: ?\d{1,3})?(?![\p{L}\d])",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]{{1,40}}+(?: \p{{Lu}}[\p{{L}}'-]{{1,40}}+)?",
}


def _combined() -> str:
    parts = {k: v.replace(r"([ -])\d{4}\g\d{4}\g", r"(?<s>[ -])\d{4}\k<s>\d{4}\k<s>") for k, v in PATTERNS.items()}
    return "|".join(f"({v})" if k == "secret" else f"(?:{v})" for k, v in parts.items())


#: Group 1 is a secret's, whatever else its characters look like.
ANY = _combined()
_SECRET_KEY = r"""(?i:token|secret|passwd|password|api_key|apikey|api-key)\s{0,3}[=:]\s{0,3}["']"""
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: A text without any of these holds no entity; two cheap scans.
HINTS = (r"[@0-9\"']", rf"(?<!\p{{L}})(?:{_TITLE})\.? ")

_NAMES = {
    ("latin", "m"): "Albert Bruno Carl Daniel Edgar Felix Gregor Hugo Ivan Julius Konrad Leon Martin Norbert Oscar Paul Quentin Robert Simon Thomas",
    ("latin", "f"): "Agnes Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Lena Maria Nora Olga Paula Rosa Sonia Teresa Ursula",
    ("latin", "n"): "Alex Ariel Charlie Dominique Eden Frankie Gabriel Jamie Kim Lee Maxime Noa Quinn Robin Sacha Sam Terry Toni Vivian Yael",
    ("latin", "s"): "Adler Barnes Castell Dorne Ebner Farrow Garland Hollis Ingram Jensen Keller Lambert Marlow Norden Orton Palmer Quist Renner Stell Thorne",
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Римма",
    ("cyrillic", "n"): "Саша Женя Валя Шура Слава",
    ("cyrillic", "s"): "Авдеенко Бойко Гончар Дорошенко Ермак Живаго Зинченко Коваль Лысенко Мороз Нечай Остапенко Павленко Рудь Савченко",
    ("greek", "m"): "Αλέξης Γιάννης Δημήτρης Ηλίας Κώστας Λεωνίδας Νίκος Πέτρος Σταύρος Φίλιππος",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δάφνη Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία",
    ("greek", "n"): "Αλέξης Άρτεμις Κλέα Χάρη Φάνη",
    ("greek", "s"): "Αλεξίου Βλάχου Γεωργίου Δήμου Ζήση Κωστή Λάμπρου Νικολάου Παύλου Σταμάτη",
}
_SYLLABLES = {"latin": "ba co den fer gol han ker lim mar nov per ris sol tan vel", "cyrillic": "ба во дер кол лен мор нов рус сал тим", "greek": "βα δο κα λε μαν νο πα ρο σα τι"}
_ALPHABETS = [(r"[0-9]", "0123456789"), (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")] + [
    (p, a)
    for script, low in (("IsLatin", "àáâãäåæçèéêëìíîïñòóôõöøùúûü"), ("IsGreek", "αβγδεζηθικλμνξοπρστυφχψω"), ("IsCyrillic", "абвгдежзиклмнопрстуфхцчшэюя"), ("IsArabic", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), ("IsHebrew", "אבגדהוזחטיכלמנסעפצקרשת"), ("IsHiragana", "あいうえおかきくけこさしすせそ"), ("IsKatakana", "アイウエオカキクケコサシスセソ"), ("IsHan", "山川田中木水火土金日月天地人大小"))
    for p, a in ((rf"[\p{{{script}}}&&\p{{Lu}}]", low.upper()), (rf"[\p{{{script}}}&&\p{{L}}]", low))
]


@dataclass(frozen=True)
class PiiConfig:
    """key: the secret that surrogates depend on. broadcast_rows: most entities of later attempts that are broadcast."""

    key: str = "surrogate-key-1"
    broadcast_rows: int = 100_000
    max_attempts: int = 40


def luhn_digit(body: Column) -> Column:
    """The check digit that completes a card number."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.reverse(_chars(body)), weigh), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def valid_card(digits: Column) -> Column:
    n = F.length(digits)
    return luhn_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1))


def iban_digits(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN."""
    chars = _chars(F.concat(body, country, F.lit("00")))
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def valid_iban(flat: Column) -> Column:
    return iban_digits(F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))) == F.substring(flat, 3, 2)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def kind(s: Column) -> Column:
    """The type of a detected entity; `none` for a number that only looks like one, which stays."""
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(s.rlike(r"^(?:\+|\()|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(s.rlike(r"^[\d -]{13,23}$"), F.when(valid_card(F.regexp_replace(s, "[^0-9]", "")), "card").otherwise("none"))
        .when(s.rlike(r"^[A-Z]{2}\d{2} ?(?:[A-Z]{4}|\d{4})(?: ?\d{4}){2,6}(?: ?\d{1,3})?$"), F.when(valid_iban(F.regexp_replace(s, " ", "")), "iban").otherwise("none"))
        .when(s.rlike(rf"^(?:{_TITLE})\.? \p{{Lu}}"), "name")
        .otherwise("secret")
    )


def canonical(s: Column, k: Column) -> Column:
    """What two mentions of one entity have in common."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when(k == "phone", F.when(s.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))).when(k.isin("card", "ssn"), digits).when(k == "iban", F.regexp_replace(s, " ", "")).when(k == "secret", s).when(k == "name", F.lower(F.regexp_replace(s, r"^\S+ ", ""))).otherwise(F.lower(s))


def _pick(options: str, r: Column, sep: str | None = None) -> Column:
    if sep is None:
        return F.substring(F.lit(options), (F.pmod(r, F.lit(len(options))) + 1).cast("int"), F.lit(1))
    words = options.split(sep)
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(r, F.lit(len(words))).cast("int"))


def scrambled(s: Column, seed: Column, letters: str | None = None) -> Column:
    """Every letter and digit replaced by one of its script and case, drawn by its number among them; all else stays."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        r = F.xxhash64(seed, acc["i"])
        out = None
        for pattern, alphabet in _ALPHABETS:
            if letters and pattern in ("[a-z]", "[A-Z]"):
                alphabet = letters.upper() if pattern == "[A-Z]" else letters
            out = F.when(c.rlike(pattern), _pick(alphabet, r)) if out is None else out.when(c.rlike(pattern), _pick(alphabet, r))
        return F.struct(F.concat(acc["o"], out.otherwise(c)).alias("o"), (acc["i"] + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("i"))

    return F.aggregate(_chars(s), start, step)["o"]


def overlaid(s: Column, digits: Column) -> Column:
    """`s` with its digits replaced by `digits` in turn."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))
    return F.aggregate(_chars(s), start, lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["o"], F.substring(digits, a["i"], F.lit(1))).alias("o"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["i"].alias("i"))))["o"]


def titled(s: Column) -> Column:
    """The gender that a mention's title tells: m, f, or n for neither."""
    bare = F.regexp_replace(F.regexp_extract(s, r"^(\S+) ", 1), r"\.", "")
    return F.when(bare.isin(*_TITLES["m"]), "m").when(bare.isin(*_TITLES["f"]), "f").otherwise("n")


def _name(s: Column, seed: Column, attempt: Column, gender: Column) -> Column:
    title, rest = F.regexp_extract(s, r"^(\S+ )", 1), F.regexp_replace(s, r"^\S+ ", "")
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    choose = lambda part, r: reduce(lambda c, sc: c.when(script == sc, part(sc, r)), ("cyrillic", "greek"), F.when(script == "latin", part("latin", r)))
    first = choose(lambda sc, r: F.when(gender == "m", _pick(_NAMES[sc, "m"], r, " ")).when(gender == "f", _pick(_NAMES[sc, "f"], r, " ")).otherwise(_pick(_NAMES[sc, "n"], r, " ")), F.xxhash64(seed, F.lit(0)))
    last = choose(lambda sc, r: _pick(_NAMES[sc, "s"], r, " "), F.xxhash64(seed, F.lit(1)))
    # the lists are finite: from the second attempt on a surname gets a made-up part, longer with every attempt
    made = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt + 1)), lambda i: choose(lambda sc, r: _pick(_SYLLABLES[sc], r, " "), F.xxhash64(seed, i + 1))), F.lit(""), lambda a, x: F.concat(a, x))
    last = F.when(attempt > 0, F.concat(last, F.lit("-"), F.initcap(made))).otherwise(last)
    out = F.when(rest.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)
    return F.concat(title, F.when(rest == F.upper(rest), F.upper(out)).otherwise(out))


def seeded(k: Column, canon: Column, attempt: Column, cfg: PiiConfig) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(cfg.key), k, canon, attempt.cast("string")), 256)


def surrogate(s: Column, k: Column, seed: Column, attempt: Column, gender: Column) -> Column:
    """The surrogate of mention `s` of type `k`, of a person of that gender. All arguments are columns or fields, as they are used many times."""
    draw = lambda i: F.xxhash64(seed, i)
    email = F.concat(scrambled(F.regexp_extract(s, r"^(.*)\.[^.]*$", 1), seed), F.regexp_extract(s, r"(\.[^.]*)$", 1))
    octet = lambda o, i: F.when(F.length(o) == 1, 1 + F.pmod(draw(i), F.lit(9))).when(F.length(o) == 2, 10 + F.pmod(draw(i), F.lit(90))).otherwise(100 + F.pmod(draw(i), F.lit(156))).cast("string")
    ip = F.array_join(F.transform(F.split(s, r"\."), octet), ".")
    number = canonical(s, F.lit("phone"))
    code = F.when(s.startswith("+"), F.regexp_extract(number, _COUNTRY, 0)).otherwise("")
    phone = overlaid(s, F.concat(code, scrambled(F.regexp_replace(number, _COUNTRY, ""), seed)))
    digits = F.regexp_replace(s, "[^0-9]", "")
    ssn = overlaid(s, F.concat(F.lit("9"), scrambled(F.substring(digits, 2, 8), seed)))
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), scrambled(F.substring(digits, F.lit(2), n - 2), seed))
    card = overlaid(s, F.concat(body, luhn_digit(body)))
    flat = F.regexp_replace(s, " ", "")
    country, bank = F.substring(flat, 1, 2), scrambled(F.substring(flat, F.lit(5), F.length(flat)), seed)
    spaced = F.concat(country, iban_digits(country, bank), bank)
    iban = F.when(s.contains(" "), F.trim(F.regexp_replace(spaced, "(.{4})", "$1 "))).otherwise(spaced)
    secret = F.when(s.rlike("^[0-9a-fA-F]+$"), scrambled(s, seed, "abcdef")).otherwise(scrambled(s, seed))
    return F.when(k == "email", email).when(k == "ip", ip).when(k == "phone", phone).when(k == "ssn", ssn).when(k == "card", card).when(k == "iban", iban).when(k == "name", _name(s, seed, attempt, gender)).when(k == "secret", secret).otherwise(s)


def found(text: Column) -> Column:
    """array<string> of the mentions in a text, in order; null and text without a mention: empty."""
    return F.when(text.rlike(HINTS[0]) | text.rlike(HINTS[1]), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kinds(text: Column, forms: Column) -> Column:
    """array<struct<s, k>>: the mentions of a text and their types, a secret by the alternative that matched."""
    plain = F.transform(forms, lambda s: F.struct(s.alias("s"), kind(s).alias("k")))
    secrets = F.regexp_extract_all(text, F.lit(ANY), F.lit(1))
    return F.when((F.size(forms) > 0) & text.rlike(_SECRET_KEY), F.zip_with(plain, secrets, lambda x, q: F.struct(x["s"].alias("s"), F.when(q != "", "secret").otherwise(x["k"]).alias("k")))).otherwise(plain)


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities: kind, canon, form (a mention, the smallest), n mentions, gender (what its titles agree on, else n)
    and mixed (a mention's title tells another gender); summed before they are shuffled."""
    rows = df.select(F.col(text).alias("text"), found(F.col(text)).alias("forms"))
    rows = rows.select(F.explode(kinds(F.col("text"), F.col("forms"))).alias("x")).select(F.col("x.s").alias("form"), F.col("x.k").alias("kind"))
    rows = rows.filter("kind <> 'none'").withColumn("title", F.when(F.col("kind") == "name", titled(F.col("form"))).otherwise("n"))
    told = [F.max(F.col("title") == g) for g in "mfn"]
    sums = rows.groupBy("kind", canonical(F.col("form"), F.col("kind")).alias("canon")).agg(F.min("form").alias("form"), F.count("*").alias("n"), *[t.alias(g) for t, g in zip(told, "mfx")])
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    mixed = F.col("m").cast("int") + F.col("f").cast("int") + F.col("x").cast("int") > 1
    return sums.select("kind", "canon", "form", "n", gender.alias("gender"), mixed.alias("mixed"))


def attempts(known: DataFrame, cfg: PiiConfig) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate collides; empty if none does."""
    own = known.select("kind", F.col("canon").alias("value"))
    open_, done, later = known.select("kind", "canon", "form", "gender"), None, None
    for n in range(cfg.max_attempts):
        drawn = open_.withColumn("seed", seeded(F.col("kind"), F.col("canon"), F.lit(n), cfg)).withColumn("value", surrogate(F.col("form"), F.col("kind"), F.col("seed"), F.lit(n), F.col("gender")))
        drawn = drawn.withColumn("value", canonical(F.col("value"), F.col("kind")))
        taken = own if done is None else own.unionByName(done)
        claims = taken.select("kind", "value", F.lit(1).alias("blocked"), F.lit(None).cast("string").alias("canon")).unionByName(drawn.select("kind", "value", F.lit(0).alias("blocked"), "canon"))
        wins = claims.groupBy("kind", "value").agg(F.max("blocked").alias("blocked"), F.min("canon").alias("winner")).filter("blocked = 0").select("kind", F.col("winner").alias("canon"), "value")
        wins = cut(wins)
        left = cut(open_.join(wins, ["kind", "canon"], "left_anti"))
        if n:
            now = wins.select("kind", "canon", F.lit(n).alias("attempt"))
            later = now if later is None else later.unionByName(now)
        if left.isEmpty():
            return later if later is not None else wins.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
        done = wins.select("kind", "value") if done is None else done.unionByName(wins.select("kind", "value"))
        open_ = left
    raise ValueError(f"collisions are left after {cfg.max_attempts} attempts")


def replaced(df: DataFrame, text: str = "text", cfg: PiiConfig = PiiConfig(), count: str | None = "n_entities") -> DataFrame:
    """`df` with every entity in `text` replaced, and the number of mentions in column `count`."""
    known = cut(entities(df, text))
    later = known.join(attempts(known, cfg), ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    later = cut(later.filter("attempt > 0 or mixed").select("kind", "canon", "attempt", "gender"))
    n_later = later.count()
    t = F.col(text)
    forms, look = free_name(df.columns, "__forms"), free_name(df.columns, "__later")
    # each step is a column of its own, so that no expression is copied into the next
    rows = df.withColumn(forms, found(t)).withColumn(forms, kinds(t, F.col(forms)))
    rows = rows.withColumn(forms, F.transform(forms, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), canonical(x["s"], x["k"]).alias("c"))))
    key = lambda x: F.concat(x["k"], F.lit("\x00"), x["c"])
    entry = F.struct(F.concat("kind", F.lit("\x00"), "canon").alias("k"), F.struct("attempt", "gender").alias("v"))
    hit = lambda x: F.try_element_at(F.col(look), key(x))
    if n_later == 0:
        hit = lambda x: F.lit(None).cast("struct<attempt:int,gender:string>")
    elif n_later <= cfg.broadcast_rows:
        one = later.agg(F.map_from_entries(F.collect_list(entry)).alias(look))  # one row, n_later entries at most
        rows = rows.crossJoin(F.broadcast(one))
    else:
        # texts are named by their hash; a text's own entities are all that its map holds
        rows = rows.withColumn("__text_key", F.sha2(t, 256))
        mentions = rows.filter(F.size(forms) > 0).select("__text_key", F.explode(F.array_distinct(F.transform(forms, key))).alias("k"))
        maps = mentions.distinct().join(later.select(entry["k"].alias("k"), entry["v"].alias("v")), "k").groupBy("__text_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(look))
        rows = rows.join(cut(maps), "__text_key", "left").drop("__text_key")
    rows = rows.withColumn(forms, F.transform(forms, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["c"].alias("c"), hit(x).alias("v"))))
    rows = rows.withColumn(forms, F.transform(forms, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["c"].alias("c"), F.coalesce(x["v"]["attempt"], F.lit(0)).alias("n"), F.coalesce(x["v"]["gender"], titled(x["s"])).alias("g"))))
    rows = rows.withColumn(forms, F.transform(forms, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), seeded(x["k"], x["c"], x["n"], cfg).alias("seed"), x["n"].alias("n"), x["g"].alias("g"))))
    subs = F.transform(F.col(forms), lambda x: surrogate(x["s"], x["k"], x["seed"], x["n"], x["g"]))
    new = F.array_join(F.zip_with(F.split(t, ANY, -1), subs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = {text: F.when(F.size(forms) == 0, t).otherwise(new)}
    if count:
        out[count] = F.size(F.filter(F.col(forms), lambda x: x["k"] != "none")).cast("long")
    return rows.withColumns(out).drop(forms, look)
