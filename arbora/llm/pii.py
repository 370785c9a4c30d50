"""Surrogates for personal data, in DataFrame functions alone: keyed, of the entity's type, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import join_small, save, table

FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra"]
MALE = ["Mr", "Herr", "Monsieur", "Señor"]
NEUTRAL = ["Dr", "Prof", "Professor"]
ONSET, RIME = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "br", "st", "tr"], ["a", "e", "i", "o", "u", "an", "el", "er", "in", "on", "ar", "es", "il", "or", "ut", "en"]
TITLE = rf"(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.?\s"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: In the order of the alternation: the first that fits where a match starts wins.
PATTERNS = [
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}))+",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<=(?i:password|passwd|pwd|secret|api_key|apikey|access_key|token)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,128}|(?:gh[oprsu]|github_pat|sk|xox[abprs])[_-][A-Za-z0-9_-]{16,255})(?![A-Za-z0-9])",
    rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)",
    r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])",
    r"(?<![\w.+])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?!\w)",
    r"(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    rf"(?<!\p{{L}}){TITLE}\p{{Lu}}\p{{Ll}}+(?:\s\p{{Lu}}\p{{Ll}}+)?",
]
ANY = "|".join(f"(?:{p})" for p in PATTERNS)
CARD, PHONE = 7, 8
#: Where a card number starts and ends.
EDGES = (r"(?<![\w.+-])", r"(?![\w-])")
#: Texts in which the card pattern may join numbers: only check digits tell what is one.
JOINED = rf"(?=\d{{1,18}}[ -]\d){PATTERNS[CARD]}"
#: Names that are made of syllables; those of other scripts are poured.
LATIN = r"^\p{IsLatin}+$"
#: How the numbers of cards begin, by issuer, and how long they are.
ISSUED = (
    r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}"
    r"|3(?:0[0-59]|[689]\d)\d{11,16}|35(?:2[89]|[3-8]\d)\d{12,15}|(?:50|5[6-9]|6\d)\d{11,17})$"
)
#: A phone number's plus sign and country code.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What may start within a run of digits and is no card.
OTHERS = "|".join(f"(?:{p})" for k, p in enumerate(PATTERNS) if k not in (2, 3, CARD))
#: The usual shapes of cards; those of any other shape count where nothing else starts in them.
USUAL = rf"\d(?:(?!{OTHERS})\d){{12,18}}|\d{{4}}(?:[ -](?!{OTHERS})\d{{4}}){{3}}|\d{{4}}[ -](?!{OTHERS})\d{{6}}[ -](?!{OTHERS})\d{{5}}"


def digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def luhn_sum(d: Column, odd: int) -> Column:
    """Of a digit string; doubles every second digit from the right, first the last one if odd = 1."""
    def add(acc: Column, i: Column) -> Column:
        v = F.substr(F.reverse(d), i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return acc + F.when(i % 2 == odd, twice).otherwise(v)

    return F.when(F.length(d) > 0, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)).otherwise(0)


def is_card(d: Column) -> Column:
    return (luhn_sum(d, 0) % 10 == 0) & d.rlike(ISSUED)


def valid(text: Column, shape: Column) -> Column:
    """As alternatives of a pattern: the card numbers (right check digit, known issuer) of a shape, from every place of the text."""
    every = F.regexp_extract_all(text, F.concat(F.lit(f"(?=({EDGES[0]}(?:"), shape, F.lit(f"){EDGES[1]}))")), F.lit(1))
    right = F.filter(F.array_distinct(every), lambda c: is_card(digits(c)))
    return F.when(F.size(right) > 0, F.array_join(right, "|")).otherwise("(?!)")


def patterns(text: Column) -> Column:
    """ANY; for texts where the card pattern joins numbers, with their own card numbers in its place.

    So what has a wrong check digit is no match, and is searched for whatever else starts in it. Cards of the usual shapes
    go before those of others, and before phone numbers that run into them. Of other shapes are those in groups of four
    digits and more, and any that begins a run of numbers and goes on as far as it may: of all windows of a table of small
    numbers, one in ten would have a right check digit.
    """
    usual = valid(text, F.lit(USUAL))
    card = F.concat(F.lit(EDGES[0] + "(?:"), usual, F.lit(f"){EDGES[1]}"))
    free = F.concat(F.lit(f"(?!{OTHERS}|"), card, F.lit(r")\d"))
    rest = [valid(text, F.concat(F.lit(r"\d(?:(?:(?<=\d{4})[ -](?=\d{4}))?"), free, F.lit(f"){{{n}}}"))) for n in range(18, 11, -1)]
    rest.append(valid(text, F.concat(F.lit(r"(?<!\d[ -])\d(?:[ -]?"), free, F.lit("){12,18}"))))
    any_card = F.concat(F.lit(EDGES[0] + "(?:"), F.concat_ws("|", usual, *rest), F.lit(f"){EDGES[1]}"))
    phone = F.concat(F.lit(r"(?!\d{3}[ .-](?:\d{3,4}[ .-])?"), card, F.lit(f"){PATTERNS[PHONE]}"))
    own = F.concat_ws("|", *[F.concat(F.lit("(?:"), any_card if k == CARD else phone if k == PHONE else F.lit(p), F.lit(")")) for k, p in enumerate(PATTERNS)])
    return F.when(text.rlike(JOINED), own).otherwise(ANY)


def kind(e: Column) -> Column:
    """Type of a match; null if it is none after all, as for a card number of a wrong check digit."""
    n = F.length(digits(e))
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^{TITLE}"), "name")
        .when(e.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ipv4")
        .when(e.rlike(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"), "ipv6")
        .when(e.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when((n >= 13) & (n <= 19) & is_card(digits(e)), "card").when(e.rlike(r"^\d{3}[ -]\d{3}[ -]\d{4}$"), "phone"))
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "id")
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})+") & ~e.rlike(r"^(AKIA|ASIA)"), "iban")
        .when(e.rlike(r"^[+(]|^\d{3}[ .-]\d{3,4}[ .-]\d{4}$"), "phone")
        .otherwise("secret")
    )


def norm(e: Column, t: Column) -> Column:
    """What two mentions of one entity share: digits, whatever their separators; letters, whatever their case."""
    return F.when(t.isin("phone", "card", "id"), digits(e)).when(t.isin("email", "ipv6"), F.lower(e)).when(t == "iban", F.regexp_replace(e, " ", "")).when(t == "name", F.regexp_extract(e, r"\S+$", 0)).when(e.rlike("^[0-9a-fA-F]{32,128}$"), F.lower(e)).otherwise(e)


def given(e: Column) -> Column:
    """The given name of a mention with a title; empty where there is none."""
    return F.regexp_extract(F.regexp_replace(e, rf"^{TITLE}", ""), r"^(\S+)\s", 1)


def given_kind(e: Column) -> Column:
    """A given name's kind: by the title, or by its last letter where the title tells nothing."""
    woman = e.rlike(rf"^(?:{'|'.join(FEMALE)})\b") | (e.rlike(rf"^(?:{'|'.join(NEUTRAL)})\b") & given(e).rlike("[ae]$"))
    return F.when(woman, "given_f").otherwise("given_m")


def units(e: Column, t: Column) -> Column:
    """The entities of a mention, as structs of (kind, norm, e): its own, or a family name and a given name, which are each
    replaced alike wherever they stand, also without the other."""
    one = F.struct(t.alias("kind"), norm(e, t).alias("norm"), F.when(t == "name", F.regexp_extract(e, r"\S+$", 0)).otherwise(e).alias("e"))
    return F.when((t == "name") & (given(e) != ""), F.array(one, F.struct(given_kind(e).alias("kind"), given(e).alias("norm"), given(e).alias("e")))).otherwise(F.array(one))


def byte(h: Column, i: Column) -> Column:
    """The i-th byte, from 1, of the 64 of a hex digest, over and over."""
    return F.conv(F.substr(h, ((i - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pour(e: Column, h: Column, hexadecimal: Column, keep: Column) -> Column:
    """Each character after the first ``keep`` by a keyed one of its class and script; digits and letters count, marks stay."""
    def one(i: Column) -> Column:
        c = F.substr(e, i, F.lit(1))
        b = byte(h, F.length(F.regexp_replace(F.substr(e, F.lit(1), i), r"[^\p{L}\p{N}]", "")))
        ring = [("0-9", 48, 10), ("a-z", 97, 26), ("A-Z", 65, 26), ("а-я", 0x430, 32), ("А-Я", 0x410, 32), ("α-ρ", 0x3B1, 17), ("Α-Ρ", 0x391, 17)]
        out = F.when(i <= keep, c).when(hexadecimal & c.rlike("[a-f]"), F.char(97 + b % 6)).when(hexadecimal & c.rlike("[A-F]"), F.char(65 + b % 6))
        for cls, base, n in ring:  # char() takes codes to 255; other scripts are looked up
            letter = F.char(base + b % n) if base < 256 else F.substr(F.lit("".join(chr(base + k) for k in range(n))), b % n + 1, F.lit(1))
            out = out.when(c.rlike(f"[{cls}]"), letter)
        latin = F.char(97 + b % 26)
        return out.when(c.rlike(r"\p{Ll}"), latin).when(c.rlike(r"\p{Lu}"), F.upper(latin)).otherwise(c)

    return F.when(F.length(e) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), one), "")).otherwise(e)


def mod97(x: Column) -> Column:
    """Of a string of digits and capital letters, which count as 10 to 35."""
    def add(acc: Column, i: Column) -> Column:
        c = F.substr(x, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.when(F.length(x) > 0, F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), add)).otherwise(0)


def pick(words: list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), b % len(words) + 1)


def digest(t: Column, n: Column, attempt: Column, key: str) -> Column:
    """What a surrogate is made of: it depends on the key, the type, the normal form and the attempt alone."""
    return F.sha2(F.concat_ws("|", F.lit(key), t, n, attempt.cast("string")), 512)


def syllables(h: Column, n: Column) -> Column:
    """A name of n syllables."""
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(pick(ONSET, byte(h, i * 2)), pick(RIME, byte(h, i * 2 + 1)))), ""))


def shape(e: Column, t: Column) -> Column:
    """What of an entity is poured: src, of which the first ``keep`` characters stay, in hexadecimal or not."""
    src = F.when(t == "email", F.substring_index(e, "@", 1)).when((t == "ipv4") | (t.isin("name", "given_f", "given_m") & e.rlike(LATIN)), "").otherwise(e)
    keep = (
        F.when(t == "card", F.when(e.rlike("^(?:2|35)"), 4).otherwise(2))  # the issuer's
        .when(t == "phone", F.length(F.regexp_extract(e, COUNTRY, 0))).when(t == "iban", 4)
        .when(t == "secret", F.length(F.regexp_extract(e, "^(?:AKIA|ASIA|(?:gh[oprsu]|github_pat|sk|xox[abprs])[_-])", 0))).otherwise(0)
    )
    return F.struct(src.alias("src"), keep.alias("keep"), ((t == "ipv6") | ((t == "secret") & ~e.rlike("[g-zG-Z]"))).alias("hex"))


def surrogate(e: Column, t: Column, h: Column, attempt: Column, w: Column, key: str) -> Column:
    """The replacement of an entity in its own format, from its digest h and its poured shape w. Names grow with their
    attempts, so that they never run out."""
    domain = F.substring_index(e, "@", -1)
    host = F.regexp_replace(domain, r"(?i)\.?(?:example\.)?[\p{L}\p{N}-]+$", "")
    host = F.when(domain.rlike(r"(?i)^example\.[a-z]+$"), F.lit("")).otherwise(host)
    host_h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(domain)), 512)
    email = F.concat(w, F.lit("@"), pour(host, host_h, F.lit(False), F.lit(0)), F.substr(domain, F.length(host) + 1))
    ip = F.concat_ws(".", (byte(h, F.lit(1)) % 222 + 1).cast("string"), byte(h, F.lit(2)).cast("string"), byte(h, F.lit(3)).cast("string"), (byte(h, F.lit(4)) % 254 + 1).cast("string"))
    body = F.substr(w, F.lit(1), F.length(w) - 1)
    card = F.concat(body, ((10 - luhn_sum(digits(body), 1) % 10) % 10).cast("string"))
    check = 98 - mod97(F.concat(F.regexp_replace(F.substr(w, F.lit(5)), " ", ""), F.substr(w, F.lit(1), F.lit(2)), F.lit("00")))
    iban = F.concat(F.substr(w, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), F.substr(w, F.lit(5)))
    ending = F.when(t == "given_f", "a").when(t == "given_m", "o").otherwise("")
    name = F.concat(syllables(h, attempt + F.when(t == "name", 3).otherwise(2)), ending)
    return (
        F.when(t == "email", email).when(t == "ipv4", ip).when(t == "card", card).when(t == "iban", iban)
        .when(t.isin("name", "given_f", "given_m") & e.rlike(LATIN), name).when(t.isNull(), e).otherwise(w)
    )


def found(text: Column) -> Column:
    """All matches, in order; an empty array where there are none, without a run of the long pattern where no character asks for it."""
    return F.when(text.rlike(rf"[0-9@=:]|{TITLE}"), F.regexp_extract_all(text, patterns(text), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (kind, norm) of a corpus with an example."""
    e = docs.select(F.explode(F.array_distinct(found(F.col("text")))).alias("e")).withColumn("kind", kind(F.col("e"))).where("kind is not null")
    e = e.select(F.explode(units(F.col("e"), F.col("kind"))).alias("u")).select("u.*")
    return e.groupBy("kind", "norm").agg(F.min("e").alias("e"))


def attempts(ents: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate is another's too, or is itself an entity: drawn anew until none is.

    Keys are hashes, so no group of them is large. All in joins; the driver sees counts.
    """
    now = save(ents.withColumn("attempt", F.lit(0)), "entities")
    while True:
        new = now.withColumn("h", digest(F.col("kind"), F.col("norm"), F.col("attempt"), key)).withColumn("s", shape(F.col("e"), F.col("kind")))
        new = new.withColumn("w", pour(F.col("s.src"), F.col("h"), F.col("s.hex"), F.col("s.keep")))
        new = new.withColumn("to", surrogate(F.col("e"), F.col("kind"), F.col("h"), F.col("attempt"), F.col("w"), key))
        new = new.withColumn("to", norm(F.col("to"), F.col("kind")))
        twice = F.row_number().over(Window.partitionBy("kind", "to").orderBy("attempt", "norm")) > 1
        real = ents.select("kind", F.col("norm").alias("to"), F.lit(True).alias("real"))
        bad = save(new.withColumn("twice", twice).join(real, ["kind", "to"], "left").withColumn("bad", F.col("twice") | F.coalesce("real", F.lit(False))).select("kind", "norm", "e", "attempt", "bad"), "entities")
        if not bad.where("bad").limit(1).count():
            return bad.where("attempt > 0").select("kind", "norm", "attempt")
        now = bad.withColumn("attempt", F.col("attempt") + F.col("bad").cast("int")).drop("bad")


def replace(docs: DataFrame, key: str = "arbora") -> DataFrame:
    """``docs`` with surrogates in their ``text``, and n_replaced, the number of replaced mentions.

    One entity has one surrogate in all documents, two entities never share one (``attempts``). Null texts stay null, with
    n_replaced 0; texts without entities do not change; equal rows change alike; all columns are kept, but that a former
    n_replaced is replaced.
    """
    docs = docs.drop("n_replaced") if "n_replaced" in docs.columns else docs
    ents = save(entities(docs), "entities")
    again = attempts(ents, key)
    n = again.count()
    taken = F.lit(None).cast("map<string,int>")
    if n:  # rare: the texts that hold such an entity get a map of attempts
        hits = docs.select(F.md5("text").alias("__pii_h"), F.explode(F.array_distinct(found(F.col("text")))).alias("e")).distinct().withColumn("kind", kind(F.col("e")))
        hits = hits.select("__pii_h", F.explode(units(F.col("e"), F.col("kind"))).alias("u")).select("__pii_h", "u.kind", "u.norm").distinct()
        hits = join_small(hits, again, ["kind", "norm"], n)
        hits = save(hits.groupBy("__pii_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("__pii_again")), "attempts")
        docs, taken = join_small(docs.withColumn("__pii_h", F.md5("text")), hits, ["__pii_h"], hits.count(), "left").drop("__pii_h"), F.col("__pii_again")

    def attempt(t: Column, m: Column) -> Column:
        return F.coalesce(F.element_at(taken, F.concat_ws("|", t, m)), F.lit(0)) if n else F.lit(0)

    def whole(x: Column) -> Column:
        """A mention with the surrogates of its units in the place of them."""
        head = F.regexp_extract(x.e, rf"^{TITLE}", 0)
        named = F.when(F.size(x.u) > 1, F.concat(F.element_at(x.u, 2), F.regexp_extract(F.substr(x.e, F.length(head) + 1), r"\s", 0))).otherwise("")
        return F.when(x.t == "name", F.concat(head, named, F.element_at(x.u, 1))).otherwise(F.element_at(x.u, 1))

    def step(e: Column, made) -> Column:
        """Makes anew each unit of each mention."""
        return F.transform(e, lambda x: F.struct(x.e.alias("e"), x.t.alias("t"), F.transform(x.u, made).alias("u")))

    def held(u: Column, *more: Column) -> Column:
        return F.struct(u.kind.alias("kind"), u.e.alias("e"), u.attempt.alias("attempt"), *more)

    # each step's results are fields of the next, so that none is worked out twice
    e = F.transform(F.coalesce(found(F.col("text")), F.array().cast("array<string>")), lambda x: F.struct(x.alias("e"), kind(x).alias("t")))
    e = F.transform(e, lambda x: F.struct(x.e.alias("e"), x.t.alias("t"), units(x.e, x.t).alias("u")))
    e = step(e, lambda u: F.struct(u.kind.alias("kind"), u.norm.alias("norm"), u.e.alias("e"), attempt(u.kind, u.norm).alias("attempt")))
    e = step(e, lambda u: held(u, digest(u.kind, u.norm, u.attempt, key).alias("h"), shape(u.e, u.kind).alias("s")))
    e = step(e, lambda u: held(u, u.h.alias("h"), pour(u.s.src, u.h, u.s.hex, u.s.keep).alias("w")))
    e = step(e, lambda u: surrogate(u.e, u.kind, u.h, u.attempt, u.w, key))
    e = F.transform(e, lambda x: F.struct(whole(x).alias("to"), x.t.isNotNull().alias("is")))
    out = docs.withColumn("__pii_new", e).withColumn("__pii_parts", F.when(F.size("__pii_new") > 0, F.split("text", patterns(F.col("text")), -1)))
    pairs = F.transform(F.arrays_zip(F.slice("__pii_parts", 1, F.size("__pii_new")), "__pii_new"), lambda x: F.concat(x["0"], x["__pii_new"]["to"]))
    poured = F.concat(F.array_join(pairs, ""), F.element_at("__pii_parts", -1))
    out = out.withColumn("n_replaced", F.size(F.filter("__pii_new", lambda x: x["is"])).cast("long"))
    out = out.withColumn("text", F.when(F.size("__pii_new") > 0, poured).otherwise(F.col("text")))
    return out.select(*[c for c in docs.columns if c != "__pii_again"], "n_replaced")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"))
