"""PII: detected entities get keyed surrogates of their type, gender, script and format; distinct ones stay distinct."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, split_join, table

MALE = "Mr|Herr|Monsieur|Señor|Sr|Don"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Doña"
NEUTRAL = "Dr|Doctor|Prof|Professor|Dott|Dra|Ing"
CYRILLIC_MALE, CYRILLIC_FEMALE = "г-н|господин", "г-жа|госпожа"
TITLES = rf"(?:(?:\b(?:{MALE}|{FEMALE}|{NEUTRAL})\b|{CYRILLIC_MALE}|{CYRILLIC_FEMALE})\.? )"
#: A capitalised word, with an apostrophe after its first letter or parts behind hyphens and apostrophes; particles between names.
WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*"
PARTICLES = r"(?:(?:von|van|der|den|zu|de|da|di|du|del|la|le|bin|al) )*"
LABELS = r"password|passwd|pwd|secret|token|api[_-]?key"
# What counts as an entity, in this order; at one place the first that matches wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"\b(?i:{LABELS})(?: ?= ?[\"']?[0-9A-Za-z_+/.-]{{8,}}|: ?[\"']?(?=[A-Za-z_+/.-]*\d)[0-9A-Za-z_+/.-]{{8,}})",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?(?![\w:])",
    "phone": r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}-\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}\b|(?<![\d)-])\(\d{3}\) ?\d{3}[ .-]\d{4}\b|(?<![\d.-])\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}\b(?![.-]?\d)",
    "card": r"\b\d{16}\b|\b\d{4}(?:[ -]\d{4}){3}\b",
    "id": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "name": rf"{TITLES}+{PARTICLES}{WORD}(?: {PARTICLES}{WORD})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Two capitalised words, each pair of them: what may be a name without a title.
PAIR = rf"(?<![\p{{L}}'’-])(?=({WORD} {WORD})(?!\p{{L}}))"
#: A cheap test that every text with an entity passes.
MAYBE = rf"[@+]|(?i:{LABELS})|AKIA|\d{{3}}|\d\.\d|\b(?:{MALE}|{FEMALE}|{NEUTRAL})\b|:[0-9A-Fa-f]{{0,4}}:|{CYRILLIC_MALE}|{CYRILLIC_FEMALE}"
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge go ha he hi jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),),
    "cyrillic": ("ба бе би бо да де ди до ка ки ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то ва ве ви".split(),),
}


def _kind(e: Column) -> Column:
    out = F.when(e.rlike("^(?:" + PATTERNS["email"] + ")$"), "email").when(e.rlike(f"^(?i:{LABELS})"), "secret")
    for name in ("key", "iban", "ip6", "phone", "card", "id", "ip", "name"):
        out = out.when(e.rlike(f"^(?:{PATTERNS[name]})$"), F.when(_luhn(_digits(e)) == _digits(e), "card").otherwise("number") if name == "card" else F.lit(name))
    return out


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _byte(hexed: Column, i: Column | int) -> Column:
    at = (i % 64) * 2 + 1
    return F.conv(F.substr(hexed, F.lit(at) if isinstance(at, int) else at, F.lit(2)), 16, 10).cast("int")


def _from(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _shaped(text: Column, hexed: Column, kept: Column, hexadecimal: Column) -> Column:
    """Each digit and letter replaced by one of its class, from the keyed digest; the first `kept` characters stay."""

    def one(i: Column) -> Column:
        c, n = F.substr(text, i, F.lit(1)), _byte(hexed, i)
        return (
            F.when(i <= kept, c).when(c.rlike("[0-9]"), _from("0123456789", n)).when(hexadecimal & c.rlike("[a-f]"), _from("abcdef", n))
            .when(c.rlike("[a-z]"), _from("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _from("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(text)), one), "")


def _luhn(card: Column) -> Column:
    """The card number with its last digit set so that the checksum holds."""
    digits = F.regexp_replace(card, "[^0-9]", "")
    doubled = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.concat(F.substr(card, F.lit(1), F.char_length(card) - 1), ((10 - total % 10) % 10).cast("string"))


def _word(script: str, hexed: Column, attempt: Column, canon: Column) -> Column:
    """A capitalised word of four syllables, and more with each second attempt, so that words don't run out.

    A hyphen of the name's stays with another word behind it, and an apostrophe after its first letter with that letter.
    """
    bare = F.regexp_replace(canon, "^[^:]*:", "")
    behind = F.when(bare.contains("-"), F.concat(F.lit("-"), _plain_word(script, F.reverse(hexed), F.lit(0)))).otherwise(F.lit(""))
    return F.concat(F.regexp_extract(bare, r"^\p{Lu}['’]", 0), _plain_word(script, hexed, attempt), behind)


def _plain_word(script: str, hexed: Column, attempt: Column) -> Column:
    pool = F.array(*[F.lit(x) for x in SYLLABLES[script][0]])
    one = lambda k: F.element_at(pool, (_byte(hexed, 2 * k) * 256 + _byte(hexed, 2 * k + 1)) % len(SYLLABLES[script][0]) + 1)
    return F.initcap(F.concat(*[one(k) for k in range(4)], *[F.when(attempt >= 2 * k - 6, one(k)).otherwise(F.lit("")) for k in range(4, 12)]))


def surrogate(kind: Column, canon: Column, attempt: Column, secret: str) -> Column:
    """A replacement of the same kind and shape for a part of an entity, from its keyed digest.

    Names without a fixed length (words, mailboxes, domains, secrets) grow with the attempt; numbers keep their digits' count.
    """
    seed = F.concat_ws("|", F.lit(secret), kind, canon, attempt.cast("string"))
    hexed = F.concat(F.sha2(F.concat(F.lit("0|"), seed), 256), F.sha2(F.concat(F.lit("1|"), seed), 256))
    none, no = F.lit(0), F.lit(False)
    plain = lambda text, kept=none: _shaped(text, hexed, kept, no)
    more = F.substr(F.translate(F.reverse(hexed), "0123456789", "ghijkmnpqr"), F.lit(1), F.floor(attempt / 3).cast("int"))
    domain = F.concat(plain(F.regexp_replace(canon, r"\.[^.]*$", "")), more, F.regexp_extract(canon, r"\.[^.]*$", 0))
    ip = F.concat_ws(".", *[(_byte(hexed, k) % 254 + 1).cast("string") for k in range(4)])
    latin, female = F.startswith(canon, F.lit("l")), F.substr(canon, F.lit(2), F.lit(1)) == "f"
    word = F.when(latin, _word("latin", hexed, attempt, canon)).otherwise(_word("cyrillic", hexed, attempt, canon))
    given = F.concat(word, F.when(~female, F.lit("")).when(latin, F.lit("a")).otherwise(F.lit("а")))
    return (
        F.when(kind == "mailbox", F.concat(plain(F.substring_index(canon, "@", 1)), more)).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "surname", word).when(kind == "given", given)
        .when(kind == "card", _luhn(plain(canon))).when(kind == "phone", plain(F.substring_index(canon, ":", -1))).when(kind == "key", plain(canon, F.lit(4))).when(kind == "iban", plain(canon, F.lit(2))).when(kind == "ip6", _shaped(canon, hexed, none, F.lit(True)))
        .when(kind == "secret", F.concat(_shaped(canon, hexed, none, canon.rlike("^[0-9a-f]+$")), more)).otherwise(plain(canon))
    )


def _own(kind: Column, canon: Column) -> Column:
    """What a surrogate of this kind would have to be to look like the entity itself."""
    bare = F.regexp_replace(canon, "^[^:]*:", "")
    surname = F.when(F.startswith(canon, F.lit("l")), F.regexp_replace(bare, "na?$", "")).otherwise(F.regexp_replace(bare, "нова?$", ""))
    return F.when(kind == "surname", surname).when(kind.isin("given", "phone"), bare).when(kind == "mailbox", F.substring_index(canon, "@", 1)).otherwise(canon)


def entity_map(entities: DataFrame, secret: str, rounds: int = 40) -> DataFrame:
    """(kind, scope, canon, surrogate) of the distinct parts of entities; in a kind and scope no two share a surrogate and none is one of the parts.

    Collisions are looked for over all of them: of those with one surrogate the smallest keeps it, the
    others draw again with the next attempt number, until a round finds none. That must come while a kind has
    more spellings than parts: words grow without end; nine digits of an identity number are 10^9.
    """
    drawn = entities.select("kind", "scope", "canon").distinct().withColumn("attempt", F.lit(0))
    same = ["kind", "scope", "surrogate"]
    own = cut(entities.select("kind", "scope", _own(F.col("kind"), F.col("canon")).alias("surrogate")).distinct().withColumn("real", F.lit(True)))
    for _ in range(rounds):
        drawn = cut(drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), secret)))
        winners = drawn.groupBy(*same).agg(F.min("canon").alias("winner"), F.count(F.lit(1)).alias("n"))
        judged = split_join(split_join(drawn, winners, same), own, same)
        again = (F.col("n") > 1) & (F.col("canon") != F.col("winner")) | F.col("real").isNotNull()
        if judged.filter(again).isEmpty():
            return drawn.select("kind", "scope", "canon", "surrogate")
        drawn = judged.withColumn("attempt", F.col("attempt") + again.cast("int")).select("kind", "scope", "canon", "attempt")
    raise RuntimeError("more distinct entities than their format has spellings")


def _part(kind: Column | str, scope: Column | str, canon: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), lit(scope).alias("scope"), canon.alias("canon"))


def _parts(kind: Column, mention: Column) -> tuple[Column, Column]:
    """What decides that two mentions are one entity, or share a part: mailbox and domain, given name and surname, bare digits.

    Case of e-mail addresses, titles, and the marks between digits don't matter; a Cyrillic surname is told without its female ending.
    """
    low = F.lower(mention)
    domain = F.substring_index(low, "@", -1)
    gender, script = _gender(mention), F.when(mention.rlike(r"\p{IsCyrillic}$"), "c").otherwise("l")
    body = F.regexp_replace(mention, f"^{TITLES}+", "")
    last = F.substring_index(body, " ", -1)
    stem = F.when((script == "c") & (gender == "f"), F.regexp_replace(last, "а$", "")).otherwise(last)
    code = F.regexp_extract(mention, r"^\+(\d{1,3})", 1)
    digits = _digits(mention)
    first = (
        F.when(kind == "email", _part("mailbox", domain, low)).when(kind == "name", _part("surname", "", F.concat(script, F.lit(":"), stem)))
        .when(kind == "phone", _part("phone", code, F.concat(code, F.lit(":"), F.substr(digits, F.char_length(code) + 1)))).when(kind.isin("card", "number", "id"), _part(kind, "", digits))
        .when(kind == "secret", _part("secret", "", F.regexp_replace(mention, SEPARATED, ""))).when(kind == "iban", _part(kind, "", F.replace(mention, F.lit(" "), F.lit("")))).when(kind == "ip6", _part(kind, "", low))
        .otherwise(_part(kind, "", mention))
    )
    second = F.when(kind == "email", _part("domain", "", domain)).when((kind == "name") & body.contains(" ") & body.rlike(r"^\p{Lu}"), _part("given", "", F.concat(script, gender, F.lit(":"), F.substring_index(body, " ", 1))))
    return first, second


SEPARATED = r"^[^=:]*[=:] ?[\"']?"


def _gender(mention: Column) -> Column:
    """By the titles in front; titles that tell none count as male forms, as the shorter ones."""
    return F.when(F.regexp_extract(mention, f"^{TITLES}+", 0).rlike(f"(?<![\\p{{L}}-])(?:{FEMALE}|{CYRILLIC_FEMALE})(?![\\p{{L}}-])"), "f").otherwise("m")


def _filled(shape: Column, digits: Column, kind: str = "0-9") -> Column:
    """shape with its digits (or other characters of a kind) replaced by these, in order."""

    def one(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.rlike(f"[{kind}]"), F.substr(digits, F.char_length(F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{kind}]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(shape)), one), "")


def _surname(surrogate_stem: Column, gender: Column, canon: Column) -> Column:
    latin = F.startswith(canon, F.lit("l"))
    ending = F.when(latin & (gender == "f"), "na").when(latin, "n").when(gender == "f", "нова").otherwise("нов")
    return F.concat(surrogate_stem, ending)


def _rendered(kind: Column, mention: Column) -> Column:
    """The replacement of a mention from its parts' surrogates s1 and s2, in the mention's own format."""
    titles, body = F.regexp_extract(mention, f"^{TITLES}+", 0), F.regexp_replace(mention, f"^{TITLES}+", "")
    between = F.regexp_extract(F.when(F.col("s2").isNotNull(), F.regexp_replace(body, "^[^ ]+ ", "")).otherwise(body), f"^{PARTICLES}", 0)
    name = F.concat(titles, F.coalesce(F.concat("s2", F.lit(" ")), F.lit("")), between, _surname(F.col("s1"), _gender(mention), F.col("c1")))
    phone = _filled(mention, F.concat(F.regexp_extract(mention, r"^\+(\d{1,3})", 1), "s1"))
    return (
        F.when(kind == "email", F.concat("s1", F.lit("@"), "s2")).when(kind == "name", name).when(kind == "phone", phone).when(kind.isin("card", "number", "id"), _filled(mention, F.col("s1")))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, SEPARATED, 0), "s1")).when(kind == "iban", _filled(mention, F.col("s1"), "A-Z0-9")).otherwise(F.col("s1"))
    )


def with_surrogates(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities, kinds.

    The same entity gets the same surrogate in all documents, and different entities different ones: a number whatever
    marks stand between its digits, an address whatever its case, people of one surname one surname, addresses of one domain one domain. Two capitalised
    words without a title are a name where a title stands before them anywhere in the documents; a surname alone is one where its document names who bears it.
    A 16-digit number that fails its checksum is no card but a number, and replaced too.

    Each text is searched once; those with an entity are cut, others are only searched again as they pass; replacements
    are joined by id and a hash of the text, nulls with nulls. A null text stays null with no entities; empty texts stay; repeated rows are replaced alike, even
    with different texts under one id; very long texts are searched whole; other columns are ignored; an empty table gives an empty result. The key is a
    parameter of the run: who has it can repeat the mapping.
    """
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    searched = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(none)
    rows = rows.withColumn("found", F.coalesce(searched, none)).withColumn("pairs", F.coalesce(F.array_distinct(F.regexp_extract_all("text", F.lit(PAIR), F.lit(1))), none))
    some = cut(rows.filter((F.size("found") > 0) | (F.size("pairs") > 0)).withColumn("key", F.xxhash64("text")))
    mentions = some.select("doc_id", "key", F.explode(F.array_distinct("found")).alias("mention")).distinct().withColumn("kind", _kind(F.col("mention")))
    first, second = _parts(F.col("kind"), F.col("mention"))
    mentions = cut(mentions.withColumn("p1", first).withColumn("p2", second))
    parts = mentions.select(F.explode(F.array("p1", "p2")).alias("p")).filter("p is not null").select("p.*").distinct()
    known = cut(entity_map(cut(parts), secret))

    def joined(left: DataFrame, part: str, as_name: str) -> DataFrame:
        keyed = left.withColumns({"part_kind": F.col(part).getField("kind"), "scope": F.col(part).getField("scope"), "canon": F.col(part).getField("canon")})
        return split_join(keyed, known.select(F.col("kind").alias("part_kind"), "scope", "canon", F.col("surrogate").alias(as_name)), ["part_kind", "scope", "canon"]).drop("part_kind", "scope", "canon")

    mapped = joined(joined(mentions, "p1", "s1"), "p2", "s2").withColumn("c1", F.col("p1.canon"))
    mapped = cut(mapped.withColumn("to", _rendered(F.col("kind"), F.col("mention"))))
    # Names with a title, by their two words; of one that bears titles of both genders the least replacement counts.
    full = mapped.filter((F.col("kind") == "name") & F.col("p2").isNotNull())
    bare = lambda c: F.regexp_replace(c, f"^{TITLES}+", "")
    titled = full.groupBy(bare(F.col("mention")).alias("pair")).agg(F.min(bare(F.col("to"))).alias("to"))
    untitled = split_join(some.select("doc_id", "key", F.explode("pairs").alias("pair")).distinct(), titled, ["pair"], "inner")
    # Inside a document a surname alone means who bears it there with a title or a given name; whole names are put first.
    surname = lambda c: F.substring_index(c, " ", -1)
    alone = mapped.filter("kind = 'name'").select("doc_id", "key", surname(F.col("mention")).alias("pair"), surname(F.col("to")).alias("to"))
    alone = alone.unionByName(untitled.select("doc_id", "key", surname(F.col("pair")).alias("pair"), surname(F.col("to")).alias("to"))).groupBy("doc_id", "key", "pair").agg(F.min("to").alias("to"))
    untitled = untitled.select("doc_id", "key", "pair", "to", F.lit(0).alias("at")).unionByName(alone.withColumn("at", F.lit(1)))
    untitled = untitled.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("at", "pair", "to"))).alias("names"))
    per = mapped.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("mention", "to"))).alias("to"), F.collect_set("kind").alias("kinds"))
    marked = split_join(split_join(some, per, ["doc_id", "key"]), untitled, ["doc_id", "key"])
    # What stands between entities, with untitled names replaced there; each of them is counted.
    word = lambda n: F.concat(F.lit(r"(?<![\p{L}'’-])"), n["pair"], F.lit(r"(?![\p{L}’-]|'\p{L}\p{L})"))
    gaps = F.split("text", ENTITY, -1)
    names = F.coalesce("names", F.array().cast("array<struct<at:int,pair:string,to:string>>"))
    put_names = F.when(F.size(names) > 0, F.transform("gaps", lambda g: F.aggregate(names, g, lambda text, n: F.regexp_replace(text, word(n), n["to"])))).otherwise(F.col("gaps"))
    n_names = F.when(F.size(names) > 0, F.aggregate("gaps", F.lit(0), lambda n, g: n + F.aggregate(names, F.lit(0), lambda m, x: m + F.regexp_count(g, word(x))))).otherwise(F.lit(0))
    marked = marked.withColumn("gaps", F.when(F.size("found") > 0, gaps).otherwise(F.array("text"))).withColumn("n_names", n_names)
    put = F.concat(F.transform("found", lambda e: F.element_at("to", e)), F.array(F.lit("")))
    all_kinds = F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("kinds", none), F.when(F.col("n_names") > 0, F.array(F.lit("name"))).otherwise(none)))), ",")
    changed = marked.select("doc_id", F.array_join(F.zip_with(put_names, put, lambda a, b: F.concat(a, b)), "").alias("text"), (F.size("found") + F.col("n_names")).cast("long").alias("n_entities"), all_kinds.alias("kinds"))
    rest = rows.filter((F.size("found") == 0) & (F.size("pairs") == 0)).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return changed.unionByName(rest)


#: Names the setting that holds the key; without it a run is repeatable by anyone, which suits trials only.
KEY_SETTING = "spark.millrace.surrogate.key"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"set {KEY_SETTING}: without it anyone can repeat the mapping", stacklevel=2)
    return with_surrogates(table(spark, sf_dir, "documents"), key or "not secret")
