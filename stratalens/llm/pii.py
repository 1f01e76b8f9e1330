"""Surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by keyed surrogates of the same type, format, script and gender. A surrogate depends only
on the key, the type and the normal form of the entity (names also on how many distinct names there are, in powers of 16),
so every mention in every text gets the same one. All distinct entities of the corpus are then checked: two entities may
not share a surrogate, and a surrogate may not be an entity that occurs; those that clash draw again until none does.
Made-up names are long enough that fewer than one in a hundred clashes, and only those are joined back to texts.

A surname found after a title is replaced without one too, in the same text, where it stands as a person does: before a
verb, a possessive or a mark, not after an article or a preposition of place and not before another capital.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens import runtime
from stratalens.llm.base import packed, query, table

# Patterns of the entity types, titles, names. Repetitions are bounded, or possessive and run to the true end.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?"
SECRET = (rf"(?<![A-Za-z]){LABEL}(?=[A-Za-z+/_=~.-]*+[0-9])(?=(?:\.?[A-Za-z0-9+/_=~-]){{6}})"
          r"[A-Za-z0-9+/_=~-]++(?:\.++[A-Za-z0-9+/_=~-]++)*+")
KEY = r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
         r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])")
CARD = (r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})"
        r"(?![0-9])")
MALE = "Mr|Sir|Herr|Herrn|Señor|Monsieur|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Госпожа"
TITLE = rf"(?:{MALE}|{FEMALE})\.?[ ]"
PARTICLE = "(?:von|van|vom|der|den|de|del|della|di|da|dos|du|la|le|zu|zur|bin|ibn|al|el|ter|ten)"
WORD = r"\p{Lu}(?:\.(?=[ ]\p{Lu})|[\p{L}\p{M}]*+(?:['’-](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+)"
NAME = rf"(?<!\p{{L}}){TITLE}(?:{PARTICLE}[ ])*+{WORD}(?:(?:[ ]{PARTICLE})*+[ ]{WORD})*+(?!\p{{L}})"
#: What stands before a bare word that is no person, and after one that is.
ARTICLE = (r"(?<!(?<!\p{L})(?:[Tt]he|[Aa]n?|[Tt]his|[Tt]hat|[Ee]very|[Nn]o|[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Ee]in|[Ee]ine|[Ll]os|[Ll]as|"
           r"[Uu]n|[Uu]na|[Uu]ne|[Ll]es)[ ])")
PERSON = (r"(?=['’][sS]?(?!\p{L})|[ ]?(?:[,.;:!?)\]\"”»]|\z|\n)|[ ](?:and|or|und|oder|y|et|и)[ ]\p{Lu}"
          r"|[ ](?:said|says|told|tells|was|is|has|had|will|would|can|could|did|does|may|went|came|comes|wrote|writes|made|gave|took|left|"
          r"thinks|thought|knew|knows|sagte|sagt|ist|war|hat|hatte|wird|kann|schrieb|kam|ging|dijo|dice|es|fue|era|tiene|puede|"
          r"сказал|сказала|был|была|\p{Ll}{2,}(?:ed|te|ó|ет|ит|ла|ал))(?!\p{L}))")
ANY = rf"{EMAIL}|(?=[pPsStTaA]){SECRET}|(?=[0-9+(])(?:{IP}|{SSN}|{PHONE}|{CARD})|(?=[A-ZГ])(?:{KEY}|{IBAN}|{NAME})"
#: What every text with a match holds: a digit, an at sign, the start of a key, or a title.
GUARD = "[0-9@]|A[KS]IA|[MSHFГ](?:rs?|s|iss|ir|err|eñor|onsieur|осп|rau|adame|me)"
KEY_OPTION = "spark.stratalens.pii.key"
FIRST = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul",
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Ева Жанна Зоя Ирина Кира Лариса Мария Нина Ольга Полина Раиса София",
}
PARTS = {
    "latin": "ba de fi go ka le mi no pa re si to va we zu ran",
    "cyrillic": "ба ве ги до жа зе ки ло ма не по ра си ту фа цо",
}


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column, double_first: bool) -> Column:
    """Luhn sum from the right; the last digit counts double if ``double_first``."""
    def weigh(c, i):
        d = c.cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == (0 if double_first else 1), twice).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), weigh), F.lit(0), lambda a, d: a + d)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of an IBAN moved by four places, letters as 10 to 35."""
    def step(a, c):
        v = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(_chars(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))), F.lit(0), step)


def _kind(e: Column, surnames: Column) -> Column:
    """Type of a match; null if it only looks like one (a card or an IBAN with a wrong check digit)."""
    whole = lambda p: e.rlike(f"^(?:{p})$")
    return (F.when(whole(EMAIL), "email").when(whole(SECRET), "secret").when(whole(KEY), "key")
            .when(whole(IBAN), F.when(_mod97(F.replace(e, F.lit(" "), F.lit(""))) == 1, "iban"))
            .when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(PHONE), "phone")
            .when(whole(CARD), F.when(_luhn(_digits(e), False) % 10 == 0, "card")).when(whole(NAME) | F.array_contains(surnames, e), "name"))


def _units(e: Column, kind: Column) -> Column:
    """What of a match is replaced: (type, normal form), one each, but every name of a person; a single word is a surname."""
    unit = lambda t, n: F.struct(t.alias("type"), n.alias("norm"))
    one = lambda n: F.array(unit(kind, n))
    words = F.filter(F.split(e, " "), lambda w: ~w.rlike(f"^{PARTICLE}$"))
    script = F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(e.rlike(rf"^(?:{MALE})\.?[ ]"), "m").otherwise("f")
    last = unit(F.concat(F.lit("last."), script), F.get(words, F.size(words) - 1))
    first = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))),
                        lambda w: unit(F.concat_ws(".", F.lit("first"), gender, script), w))
    return (F.when(kind == "email", one(F.lower(e)))
            .when(kind == "secret", one(F.regexp_extract(e, f"^{LABEL}(.*)$", 1)))
            .when(kind == "iban", one(F.replace(e, F.lit(" "), F.lit(""))))
            .when(kind == "phone", one(F.right(_digits(e), F.lit(10))))
            .when(kind.isin("card", "ssn"), one(_digits(e)))
            .when(kind == "name", F.concat(first, F.array(last)))
            .when(kind.isNotNull(), one(e)))


def lengths(units: DataFrame) -> dict[str, int]:
    """Parts of a made-up name by type: as many as make a hundred times the names there are. A few first names stay single."""
    names = units.filter(F.col("type").rlike("^(first|last)")).groupBy("type").agg(F.count("*").alias("n")).collect()
    return {r.type: max(3 if r.type.startswith("last") else 1, ceil(log(100 * r.n, 16))) for r in names
            if r.type.startswith("last") or r.n > 4}


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column, parts: dict[str, int]) -> Column:
    """The keyed surrogate of one unit; 256 bytes from SHA-512 of key, type, normal form and attempt."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm)
    data = F.concat(*[F.sha2(F.concat_ws("|", F.lit(str(i)), seed), 512) for i in range(4)])

    def made(h: Column) -> Column:
        byte = lambda i: F.conv(F.substr(h, (i % 256) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda text, i, n: F.substr(F.lit(text), byte(i) % n + 1, F.lit(1))

        def masked(s: Column) -> Column:
            """Digits to digits, letters to letters of the same case, the rest as it is."""
            return F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.between("0", "9"), pick("0123456789", i, 10))
                                            .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz", i, 26))
                                            .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i, 26))
                                            .otherwise(c)), "")

        hexes = F.array_join(F.transform(_chars(norm), lambda c, i: pick("0123456789abcdef", i, 16)), "")
        top = F.regexp_extract(norm, r"(\.[^.]+)$", 1)
        phone = F.array_join(F.transform(_chars(norm), lambda c, i: F.when((i == 0) | (i == 3), pick("23456789", i, 8))
                                         .otherwise(pick("0123456789", i, 10))), "")
        body = F.concat(F.left(norm, F.lit(1)), F.substr(masked(norm), F.lit(2), F.length(norm) - 2))
        card = F.concat(body, ((10 - _luhn(body, True) % 10) % 10).cast("string"))
        land = F.concat(F.left(norm, F.lit(2)), F.lit("00"), F.substring(masked(norm), 5, 64))
        iban = F.concat(F.left(norm, F.lit(2)), F.lpad((98 - _mod97(land)).cast("string"), 2, "0"), F.substring(land, 5, 64))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(i) % 254 + 1).cast("string")), ".")
        ssn = F.concat(pick("12345", F.lit(0), 5), F.substring(masked(norm), 2, 8))

        def listed(text: str, count: Column, join: str) -> Column:
            words = F.array(*[F.lit(w) for w in text.split()])
            return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(words, byte(i) % 16)), join)

        out = (F.when(kind == "email", F.concat(masked(F.substr(norm, F.lit(1), F.length(norm) - F.length(top))), top))
               .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), hexes).otherwise(masked(norm)))
               .when(kind == "key", F.concat(F.left(norm, F.lit(4)), masked(F.substring(norm, 5, 16))))
               .when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip", octets)
               .when(kind == "ssn", ssn))
        for (gender, script), names in FIRST.items():
            least = parts.get(f"first.{gender}.{script}", 1)
            out = out.when(kind == f"first.{gender}.{script}", listed(names, attempt.cast("int") + least, "-"))
        for script, syllables in PARTS.items():
            least = parts.get(f"last.{script}", 3)
            out = out.when(kind == f"last.{script}", F.initcap(listed(syllables, attempt.cast("int") + least, "")))
        return out

    return F.get(F.transform(F.array(data), made), F.lit(0))


def _render(e: Column, kind: Column, units: Column) -> Column:
    """The surrogates in the format of the match: its separators, and its letter case for e-mail addresses."""
    first = F.get(units, F.lit(0))
    kept = F.length(_digits(e)) - F.length(first)
    plain = F.when(kind == "phone", F.concat(F.left(_digits(e), kept), first)).otherwise(first)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def put(a, c):
        own = F.substr(plain, a["i"] + 1, F.lit(1))
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(
            F.concat(a["out"], F.when(c.between("A", "Z"), F.upper(own)).otherwise(own)).alias("out"),
            (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))

    shaped = F.aggregate(_chars(e), start, put, lambda a: a["out"])
    letters = F.aggregate(F.transform(F.arrays_zip(_chars(e).alias("c"), _chars(first).alias("s")), lambda z: F.when(
        z["c"].between("A", "Z"), F.upper(z["s"])).otherwise(z["s"])), F.lit(""), lambda a, c: F.concat(a, c))
    return (F.when(kind == "name", F.concat(F.regexp_extract(e, f"^{TITLE}", 0), F.array_join(units, " ")))
            .when(kind == "secret", F.concat(F.regexp_extract(e, f"^({LABEL}).*$", 1), first))
            .when(kind == "email", letters).when(kind.isin("phone", "card", "ssn", "iban"), shaped).otherwise(first))


def _found(text: Column, pattern: Column, surnames: Column) -> Column:
    matches = F.when(text.rlike(GUARD), F.regexp_extract_all(text, pattern, 0)).otherwise(F.array().cast("array<string>"))
    with_kind = F.transform(matches, lambda e: F.struct(e.alias("match"), _kind(e, surnames).alias("kind")))
    return F.transform(with_kind, lambda x: F.struct(x["match"].alias("match"), x["kind"].alias("kind"),
                                                     _units(x["match"], x["kind"]).alias("units")))


def entities(rows: DataFrame) -> DataFrame:
    """Adds ``found array<struct<match, kind, units>>``, every match in order, the kind of a false one null, and ``pattern``.

    The surnames found after a title are looked for without one in the same text, so the pattern belongs to the text.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumn("titled", _found(F.col("text"), F.lit(ANY), none))
    last = F.flatten(F.transform(F.filter("titled", lambda f: f["kind"] == "name"), lambda f: f["units"]))
    known = F.transform(F.filter(last, lambda u: u["type"].startswith("last.") & (F.length(u["norm"]) > 1)), lambda u: u["norm"])
    rows = rows.withColumn("surnames", F.sort_array(F.array_distinct(known), asc=False))  # the longer of two with one start first
    some = F.size("surnames") > 0
    quoted = F.array_join(F.transform("surnames", lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    rows = rows.withColumn("pattern", F.when(some, F.concat(
        F.lit(ANY + r"|(?<![\p{L}\p{M}])" + ARTICLE + "(?:"), quoted, F.lit(r")(?![\p{L}\p{M}])" + PERSON))).otherwise(F.lit(ANY)))
    return (rows.withColumn("found", F.when(some, _found(F.col("text"), F.col("pattern"), F.col("surnames")))
                            .otherwise(F.col("titled"))).drop("titled", "surnames"))


def clashes(units: DataFrame, key: str, parts: dict[str, int]) -> DataFrame | None:
    """``type, norm, attempt`` of the entities whose first surrogate may not be used; None if there are none.

    ``units``: distinct ``type, norm``. An entity clashes if a smaller one of its type has the same surrogate, or if the
    surrogate is itself an entity of that type. Those draw again, the others stay, until nothing clashes.
    """
    real = units.select(F.col("type").alias("real_type"), F.col("norm").alias("real"))
    state = units.withColumn("attempt", F.lit(0))
    while True:
        state = state.withColumn("surrogate", _surrogate(key, F.col("type"), F.col("norm"), F.col("attempt"), parts))
        state = runtime.materialise(state)
        order = "row_number() over (partition by type, surrogate order by attempt, norm)"
        shared = state.groupBy("type", "surrogate").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        twice = (state.join(shared, ["type", "surrogate"]).withColumn("turn", F.expr(order)).filter("turn > 1")
                 .select("type", "norm"))
        taken = (state.join(real, (F.col("type") == F.col("real_type")) & (F.col("surrogate") == F.col("real")))
                 .select("type", "norm"))
        bad = runtime.materialise(twice.union(taken).distinct().select(
            F.col("type").alias("bad_type"), F.col("norm").alias("bad_norm")))
        if bad.isEmpty():
            again = state.filter("attempt > 0").select("type", "norm", "attempt")
            return None if again.isEmpty() else again
        state = (state.join(bad, (F.col("type") == F.col("bad_type")) & (F.col("norm") == F.col("bad_norm")), "left")
                 .select("type", "norm", (F.col("attempt") + F.col("bad_type").isNotNull().cast("int")).alias("attempt")))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of the input), ``text`` with surrogates, ``spans`` (type, start, length in the new text).

    A null text stays null with no spans; a text without entities stays as it is. Equal texts get equal results.
    """
    rows = entities(packed(docs, text_col))
    units = (rows.select(F.explode("found").alias("f"))
             .select(F.explode("f.units").alias("u")).select("u.type", "u.norm").distinct())
    units = runtime.materialise(units)
    parts = lengths(units)
    again = clashes(units, key, parts)
    if again is None:
        attempts = F.create_map().cast("map<string,int>")
    else:
        marks = [F.xxhash64(F.lit(s), F.col("text")) for s in (1, 2)]
        rows = rows.withColumn("mark", F.when(F.size("found") > 0, F.struct(*marks)))
        held = (rows.filter("mark is not null").select("mark", F.explode("found").alias("f"))
                .select("mark", F.explode("f.units").alias("u")).select("mark", "u.type", "u.norm").distinct()
                .join(again, ["type", "norm"]).groupBy(F.col("mark").alias("at"))
                .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "norm"), "attempt"))).alias("attempts")))
        rows = rows.join(held, F.col("mark") == F.col("at"), "left")
        attempts = F.coalesce(F.col("attempts"), F.create_map().cast("map<string,int>"))

    def surrogate(u):
        attempt = F.coalesce(F.element_at(attempts, F.concat_ws("|", u["type"], u["norm"])), F.lit(0))
        return _surrogate(key, u["type"], u["norm"], attempt, parts)

    some = F.size("found") > 0
    new = F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), F.when(
        f["kind"].isNotNull(), _render(f["match"], f["kind"], F.transform(f["units"], surrogate)))
        .otherwise(f["match"]).alias("new")))
    rows = rows.withColumn("new", F.when(some, new)).withColumn("between", F.when(some, F.split("text", F.col("pattern"), -1)))
    start = F.struct(F.element_at("between", 1).alias("out"), F.array().cast(
        "array<struct<type:string,start:int,length:int>>").alias("spans"))

    def join(a, x):
        span = F.struct(x["kind"].alias("type"), (F.length(a["out"])).alias("start"), F.length(x["new"]["new"]).alias("length"))
        return F.struct(
            F.concat(a["out"], x["new"]["new"], x["between"]).alias("out"),
            F.when(x["kind"].isNotNull(), F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    zipped = F.transform("new", lambda x, i: F.struct(x["kind"].alias("kind"), x.alias("new"),
                                                     F.get(F.col("between"), i + 1).alias("between")))
    rows = rows.withColumn("made", F.when(some, F.aggregate(zipped, start, join)))
    return rows.select("row", F.coalesce("made.out", "text").alias("text"),
                       F.coalesce("made.spans", F.array().cast("array<struct<type:string,start:int,length:int>>")).alias("spans"))


def secret_key(spark: SparkSession) -> str:
    """The key of the session's option; surrogates can only be told from the names behind them by who knows it."""
    return spark.conf.get(KEY_OPTION, "no key set")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace(table(spark, sf_dir, "documents"), key=secret_key(spark))
    return done.select("row.doc_id", "text", F.size("spans").cast("long").alias("n_entities"), "spans")


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all rows and columns, texts with surrogates, ``n_chars`` of the new text."""
    done = replace(docs, key=secret_key(spark))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
