"""Surrogate generation for personal data.

Detected entities (e-mail, card, social security, phone and IP numbers, and names
behind a title) are replaced by keyed surrogates of the same type and format:
digits become digits, letters letters of the same script and case, separators
stay; cards keep their first digit and whether their check digit is right,
addresses have valid octets of the same lengths, given names keep the gender that
the title shows.  An entity is keyed by its canonical form, so its mentions agree
over all texts and spellings (coreference).

A name runs over all capitalised words, initials and particles behind its titles.
Each word is a unit of its own: the last one and those behind a particle are family
names, the others given names; a word that is a family name once in a text is one in
the whole text.  Where these words stand in the same text without a title, they are
replaced alike.  Cards of other than 16 digits must pass the Luhn check.

Collision checks run over the distinct entities of the whole input: where two
entities have one surrogate, or a surrogate is itself an entity, all but the
smallest are keyed again with the next attempt number, until none is left
(distinctness).  All of it is DataFrame expressions.

A given name is one entity, whatever titles stand before it, and has one gender in the
whole input.  Repeated groups in the patterns are possessive, so that very long words,
names and addresses are matched in constant stack space.

Nulls: a null text stays null and has no entity.  Repeated rows give equal rows.
An empty table gives an empty result.  Other columns, of whatever names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

KEY = "change-me"
ATTEMPTS = 100
WIDE_AFTER = 8          # attempts from here on may leave the entity's exact format
KINDS = ("email", "card", "ssn", "phone", "ip", "name")

_WORD = r"[\p{L}\p{N}._%+-]"
# Titles, particles of names.
_TITLES = (r"(?:(?:Mrs|Mr|Ms|Miss|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora|Señor|Sra|Sr|г-жа|г-н"
           r"|Dra|Dr|Doctor|Doktor|Professorin|Professor|Prof)\.? )++")
PARTICLES = ("af", "al", "av", "bin", "da", "dal", "de", "degli", "del", "dela", "della", "den", "der", "des", "di", "do", "dos", "das", "du", "e", "el",
             "ibn", "la", "las", "le", "los", "san", "ten", "ter", "van", "vom", "von", "y", "zu", "zum", "zur")
_PARTS = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
_NAME = rf"(?!{_TITLES})\p{{Lu}}(?:\.|(?:[\p{{L}}\p{{M}}]|['’-](?!s(?!\p{{L}}))\p{{L}})++)"
# One pattern a kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<!{_WORD}){_WORD}++@(?:[\p{{L}}\p{{N}}-]++\.(?=[\p{{L}}\p{{N}}-]++\.|\p{{L}}{{2}}))++\p{{L}}{{2,}}",
    "card": r"(?<![\p{L}\p{N}+])(?:\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{3}){3}"
            r"|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,3}|\d{6}[ -]\d{13}|\d{13,19})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}+-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}+])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}+.])(?!\d\d[./-]\d\d[./-]\d{4})(?=\(?\d(?:[ ./()-]{0,2}\d){8,14}(?![\p{L}\p{N}]))"    # trunk or exit zeros
             r"(?:\(0\d{1,4}\)[ -]?|0\d{1,4}[ ./-])\d{2,8}(?:[ ./-]\d{2,8}){0,4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}+.])0\d{9,10}(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\p{L}\p{N}]|\.\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_PARTS}{_NAME}(?: {_PARTS}{_NAME})*+",
}
FEMALE = r"^(Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Dra|г-жа)\b"
NEUTRAL = r"^(?:(?:Dr|Doctor|Doktor|Professor|Prof)\.? )++(?!Mr|Herr|Frau|Monsieur|M[sml]|Señor|Sr)"
NAMED = ("family", "given-f", "given-m", "given-n")
GIVEN = {       # fixed values: given names by script and gender
    ("latin", "f"): "Ada Alma Berta Carla Clara Diana Edith Elena Emma Flora Greta Hanna Helen Ida Irene Julia Karin Laura Lena Lucy "
                    "Maria Marta Mila Nadia Nina Nora Olga Paula Petra Rita Rosa Ruth Sara Silvia Sofia Tania Vera Viola Wanda Zoe",
    ("latin", "m"): "Adam Albert Anton Boris Carl Daniel David Edgar Emil Erik Felix Frank Georg Gustav Hans Henry Hugo Igor Ivan Jakob "
                    "Karl Kurt Leo Lukas Marco Martin Max Milan Nils Oscar Otto Paul Peter Ralf Robert Simon Theo Thomas Victor Walter",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Жанна Зоя Инна Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Юлия",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Иван Игорь Лев Марк Никита Олег Павел Роман Тимур Юрий",
}
STEMS = {       # fixed values: parts of family names by script
    "latin": ("Ab Al An Bar Ben Bor Cal Cor Dal Den Dor El Fal Fen Gar Gor Hal Hol Is Kal Kel Lan Lor Mal Mer Nor Os Pal Per Ran Ros San Sel Tal Tor Val Ver Wal Wen Zel",
              "a e i o u an en in on ar er or al el il am em ri ro ta ti no ni la le",
              "berg den dorf feld ford gren holm ker land ley lin man mark ner rich sen son stein ton well"),
    "cyrillic": ("Ал Бар Вол Гор Дан Ев Зим Иль Кар Лан Мор Нор Ор Пав Рос Сав Тар Ур Фед Яр",
                 "а е и о у ан ен ин он ар ер ор", "дин ков лин мов нин ров син тин хин цев"),
}


def _span(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


# Characters that stand in for each other.
ALPHABETS = ("0123456789", _span(97, 122), _span(65, 90), "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ",
             _span(0x430, 0x44F), _span(0x410, 0x42F), _span(0x3B1, 0x3C9), _span(0x391, 0x3A1), _span(0x3041, 0x3096),
             _span(0x30A1, 0x30FA), _span(0x4E00, 0x51FF), _span(0xAC00, 0xADFF))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), canon), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def draw(dig: Column, at, n) -> Column:
    """Keyed number in ``0 .. n - 1`` for a place."""
    return F.pmod(F.xxhash64(dig, at if isinstance(at, Column) else F.lit(at)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def places(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))


def same_format(text: Column, dig: Column, salt: int = 0) -> Column:
    """Each digit or letter replaced within its alphabet, all else kept."""
    def one(ch, i):
        out = ch
        for a in reversed(ALPHABETS):
            out = F.when(F.call_function("instr", F.lit(a), ch) > 0, F.substring(F.lit(a), draw(dig, i + salt, len(a)) + 1, F.lit(1))).otherwise(out)
        return out
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch, i: one(ch, i + 1)), "")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits taken in order from ``digits``."""
    def filled(d):
        def step(acc, i):
            ch = F.substring(text, i, F.lit(1))
            is_digit = ch.between("0", "9")
            return F.struct(F.when(is_digit, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                            F.concat(acc["out"], F.when(is_digit, F.substring(d, acc["n"] + 1, F.lit(1))).otherwise(ch)).alias("out"))
        return F.aggregate(places(text), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda a: a["out"])
    return let(digits, filled)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit's place counted as undoubled."""
    def summed(t):
        def step(acc, i):
            d = F.substring(t, i, F.lit(1)).cast("int")
            twice = F.pmod(F.char_length(t) - i, F.lit(2)) == 1
            return acc + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)
        return F.aggregate(places(t), F.lit(0), step)
    return let(digits, summed)


def keyed_digits(n: Column, dig: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: draw(dig, i, 10).cast("string")), "")


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def pick(words: str, dig: Column, at: int) -> Column:
    w = words.split()
    return F.element_at(F.split(F.lit(words), " "), draw(dig, at, len(w)) + 1)


def title_of(value: Column) -> Column:
    return F.regexp_extract(value, f"^{_TITLES}", 0)


def name_words(value: Column) -> Column:
    return F.split(F.regexp_replace(value, f"^{_TITLES}", ""), " ")


def name_units(value: Column) -> Column:
    """``(kind, canon)`` of each word of a name; kind ``initial`` or ``particle`` for what is no unit."""
    given = F.when(value.rlike(FEMALE), F.lit("given-f")).when(value.rlike(NEUTRAL), F.lit("given-n")).otherwise(F.lit("given-m"))

    def named(words):
        first = F.array_position(F.transform(words, lambda x: F.lower(x).isin(*PARTICLES)), True)     # 0: none

        def kinds(particle):
            def kind(w, i):
                last = i + 1 == F.size(words)
                behind = (particle > 0) & (particle <= i)
                return (F.when(w.endswith("."), F.lit("initial")).when(~last & F.lower(w).isin(*PARTICLES), F.lit("particle"))
                        .when(last | behind, F.lit("family")).otherwise(given))
            return F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), F.lower(w).alias("canon")))
        return let(first, kinds)
    return let(name_words(value), named)


def units(kind: Column, value: Column, names: Column) -> Column:
    """What is keyed on its own in a mention: ``(kind, canon)``; a name has one unit for each of its
    words, of the kind that ``names``, the sorted ``(canon, kind)`` of its text, first has for it."""
    def known(u):
        own = F.get(F.filter(names, lambda n: n["canon"] == u["canon"]), F.lit(0))
        return F.struct(F.when(u["kind"] == "particle", u["kind"]).otherwise(F.coalesce(own["kind"], u["kind"])).alias("kind"), u["canon"].alias("canon"))
    canon = F.when(kind.isin("card", "ssn", "phone"), digits_of(value)).otherwise(F.lower(value))
    return F.when(kind == "name", F.transform(name_units(value), known)).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def unit_surrogate(kind: Column, text: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Surrogate of one unit as written in ``text``."""
    return let(digest(key, kind, canon, attempt), lambda dig: _unit(kind, text, canon, attempt, dig))


def _unit(kind: Column, text: Column, canon: Column, attempt: Column, dig: Column) -> Column:
    wide = attempt >= WIDE_AFTER
    n = F.char_length(canon)

    at = F.call_function("instr", text, F.lit("@"))
    domain = F.substring(text, at + 1, F.char_length(text))
    labels = F.split(domain, r"\.")
    host = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")
    tail = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    email = F.concat(same_format(F.substring(text, F.lit(1), at - 1), dig), F.when(wide, draw(dig, -3, 100_000).cast("string")).otherwise(F.lit("")),
                     F.lit("@"), same_format(host, dig, 1000), F.when(host != "", F.lit(".")).otherwise(F.lit("")), tail)

    valid = F.pmod(luhn_sum(canon), F.lit(10)) == 0
    shift = F.when(valid, F.lit(0)).otherwise(1 + draw(dig, -1, 9))         # off the right check digit as the entity's is
    card = let(F.concat(F.substring(canon, F.lit(1), F.lit(1)), keyed_digits(n - 2, dig)), lambda body: F.concat(
        body, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)) + shift, F.lit(10)).cast("string")))

    ssn = F.concat((F.lit(100) + draw(dig, -1, 565)).cast("string"), F.lpad((F.lit(1) + draw(dig, -2, 99)).cast("string"), 2, "0"),
                   F.lpad((F.lit(1) + draw(dig, -3, 9999)).cast("string"), 4, "0"))

    code = F.char_length(digits_of(F.regexp_extract(text, r"^(?:\+\d{1,3}(?!\d)|\(?0{1,2}|1[ .-])", 0)))
    fictional = F.substring(canon, code + 4, F.lit(3)) == "555"      # such an exchange stays one
    first = F.concat((F.lit(2) + draw(dig, -1, 8)).cast("string"), keyed_digits(n - code - 1, dig))
    rest = let(first, lambda r: F.when(fictional & ~wide, F.concat(
        F.substring(r, F.lit(1), F.lit(3)), F.lit("555"), F.substring(r, F.lit(7), n))).otherwise(r))
    phone = F.concat(F.substring(canon, F.lit(1), code), rest)

    octets = F.split(text, r"\.")
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(wide | (F.char_length(o) == 3), F.lit(100) + draw(dig, i, 155))
                                  .when(F.char_length(o) == 2, F.lit(10) + draw(dig, i, 90)).otherwise(F.lit(1) + draw(dig, i, 9)).cast("string")), ".")
    ip = F.when(wide, F.array_join(F.transform(octets, lambda o, i: (F.lit(1) + draw(dig, i, 254)).cast("string")), ".")).otherwise(ip)

    script = script_of(text)
    out = F.when(kind == "email", email).when(kind == "card", refill(text, card)).when(kind == "ssn", refill(text, ssn)) \
        .when(kind == "phone", refill(text, phone)).when(kind == "ip", ip) \
        .when(kind == "initial", same_format(text, dig)).when(kind.isin("particle", "plain"), text)
    name = F.lit(None).cast("string")
    for s in ("cyrillic", "latin"):
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.element_at(
            F.split(F.lit(STEMS[s][1]), " "), draw(dig, i + 50, len(STEMS[s][1].split())) + 1)), "")
        family = F.concat(pick(STEMS[s][0], dig, 1), more, pick(STEMS[s][2], dig, 3))
        one = lambda at, s=s: F.when(kind == "given-f", pick(GIVEN[s, "f"], dig, at)).when(
            kind == "given-n", pick(GIVEN[s, "f"] + " " + GIVEN[s, "m"], dig, at)).otherwise(pick(GIVEN[s, "m"], dig, at))
        given = F.when(attempt > 0, F.concat(one(1), F.lit("-"), one(2), F.when(
            wide, F.concat(F.lit("-"), pick(GIVEN[s, "f"], dig, 3), more)).otherwise(F.lit("")))).otherwise(one(1))
        full = F.when(kind == "family", family).otherwise(given)
        name = F.when(script == s, full).otherwise(name)
    name = F.when((F.char_length(text) > 1) & (F.upper(text) == text), F.upper(name)).otherwise(name)
    return F.coalesce(out, name)


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for k in reversed(KINDS[:-1]):
        anchored = F.regexp_extract(value, f"^(?:{PATTERNS[k]})$", 0) != ""
        out = F.when(anchored, F.lit(k)).otherwise(out)
    return out


def detected(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_gaps`` and ``_hits``: the text between entities, and the entities (``kind, value``);
    and ``_names``, the sorted units ``(canon, kind)`` of the titled names, whose words also are entities alone."""
    pattern = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
    df = docs.withColumn("_found", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)))
    titled = F.filter("_found", lambda v: v.rlike(f"^{PATTERNS['name']}$"))
    df = df.withColumn("_names", F.array_sort(F.array_distinct(F.flatten(F.transform(titled, lambda v: F.transform(
        F.filter(name_units(v), lambda u: u["kind"].isin(*NAMED)), lambda u: F.struct(u["canon"], u["kind"])))))))
    # longer words before those that they begin with; matches are capitalised
    words = F.array_join(F.sort_array(F.array_distinct(F.transform("_names", lambda n: n["canon"])), False), "|")
    word = F.concat(F.lit(r"(?=\p{Lu})(?iu:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    alone = F.concat(F.lit(pattern + r"|(?<![\p{L}\p{N}])"), word, F.lit(f"(?: {_PARTS}"), word, F.lit(")*+"))
    some = F.size("_names") > 0
    df = df.withColumn("_alone", F.when(some, alone))
    df = df.withColumn("_found", F.when(some, F.regexp_extract_all("text", F.col("_alone"), F.lit(0))).otherwise(F.col("_found")))

    def hit(v):
        def kind(k):
            n = F.char_length(digits_of(v))
            return F.when((k == "card") & (n != 16) & (F.pmod(luhn_sum(digits_of(v)), F.lit(10)) != 0), F.lit("plain")).otherwise(k)
        return F.struct(let(kind_of(v), kind).alias("kind"), v.alias("value"))
    return (df.withColumn("_gaps", F.when(some, F.split("text", F.col("_alone"), -1)).when(F.size("_found") > 0, F.split("text", pattern, -1)))
            .withColumn("_hits", F.transform("_found", hit)).drop("_found", "_alone"))


def collision_free(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, canon, attempt`` of the distinct ``entities(kind, canon, text)``: no two
    of a kind have one surrogate, and none has an entity as surrogate."""
    now = written(entities.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(ATTEMPTS):
        made = now.withColumn("made", unit_surrogate(F.col("kind"), F.col("text"), F.col("canon"), F.col("attempt"), key))
        made = made.withColumn("made", F.when(F.col("kind").isin("card", "ssn", "phone"), digits_of(F.col("made"))).otherwise(F.lower("made")))
        made = written(made.select("kind", "canon", "made"), "made")
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("canon"), F.count("*").alias("n")).filter("n > 1")
        twice = (made.join(first.select("kind", "made", F.col("canon").alias("keeper")), ["kind", "made"])
                 .filter("canon <> keeper").select("kind", "canon"))
        taken = made.join(entities.select("kind", F.col("canon").alias("made")).distinct(), ["kind", "made"], "left_semi").select("kind", "canon")
        again = written(twice.union(taken).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return now.select("kind", "canon", "attempt")
        now = written(now.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again"), "entities")
    raise RuntimeError("no free surrogates left for some entities: their format has too few")


def _words(h: Column, names: Column) -> Column:
    """What a mention is written anew from: ``(kind, canon, word)`` of each unit, in order."""
    parts = units(h["kind"], h["value"], names)
    words = F.when(h["kind"] == "name", name_words(h["value"])).otherwise(F.array(h["value"]))
    return F.zip_with(parts, words, lambda u, w: F.struct(
        F.when(u["kind"].startswith("given"), F.lit("given")).otherwise(u["kind"]).alias("base"), u["kind"].alias("kind"), u["canon"].alias("canon"), w.alias("word")))


def distinct_entities(mentions: DataFrame) -> DataFrame:
    """``base, canon, kind, text`` of the entities that are keyed.  A given name has one gender in the
    whole input: the one that most of its titles show (of equally many the female one)."""
    shows = lambda g: F.count_if(F.col("kind") == f"given-{g}")
    gender = F.when(F.col("f") + F.col("m") == 0, "given-n").when(F.col("f") >= F.col("m"), "given-f").otherwise("given-m")
    per = mentions.filter(~F.col("base").isin("initial", "particle", "plain")).groupBy("base", "canon") \
        .agg(shows("f").alias("f"), shows("m").alias("m"), F.min("word").alias("word"))
    return per.select("base", "canon", F.when(F.col("base") == "given", gender).otherwise(F.col("base")).alias("kind"),
                      F.when(F.col("base").isin("given", "family"), F.initcap("canon")).otherwise(F.col("word")).alias("text"))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``_hits``, the mentions found.

    Detection runs once, into a table; surrogates are made once for every entity and
    spelling; texts with mentions are put together again from these by row and place."""
    found = detected(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text")))
    found = written(found.select("row", "_gaps", "_hits", "_names").withColumn("id", F.monotonically_increasing_id()), "detected")
    some = found.filter(F.size("_hits") > 0)
    spoken = some.select("id", "_names", F.posexplode("_hits").alias("place", "h"))
    lead = F.when(F.col("h.kind") == "name", title_of(F.col("h.value"))).otherwise(F.lit(""))
    spoken = spoken.select("id", "place", lead.alias("lead"), F.posexplode(_words(F.col("h"), F.col("_names"))).alias("at", "u"))
    mentions = written(spoken.select("id", "place", "at", "lead", "u.*"), "mentions")

    entities = written(distinct_entities(mentions), "distinct-entities")
    late = collision_free(entities.select("kind", "canon", "text"), key)
    keyed = entities.join(late, ["kind", "canon"]).select("base", "canon", F.col("kind").alias("as"), "attempt")
    spelled = mentions.filter(~F.col("base").isin("particle", "plain")).select("base", "canon", "word").distinct().join(keyed, ["base", "canon"], "left")
    made = unit_surrogate(F.coalesce("as", "base"), F.col("word"), F.col("canon"), F.coalesce("attempt", F.lit(0)), key)
    spelled = written(spelled.select("base", "canon", "word", made.alias("made")), "spelled")

    said = mentions.join(spelled, ["base", "canon", "word"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "place", "at", "lead", F.coalesce("made", "word").alias("made")))).alias("said"))
    joined = some.join(said, "id")
    piece = F.transform("said", lambda e: F.concat(F.when(e["at"] == 0, F.concat(F.get("_gaps", e["place"]), e["lead"])).otherwise(F.lit(" ")), e["made"]))
    text = F.concat(F.array_join(piece, ""), F.element_at("_gaps", -1))
    own = lambda df, text: df.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], "_hits")
    return own(found.filter(F.size("_hits") == 0), F.col("row.text")).union(own(joined, text))
