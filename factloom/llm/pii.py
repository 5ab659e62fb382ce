"""Surrogates for personal data, in DataFrame functions only.

One alternation of patterns finds e-mail addresses, IPv4 addresses, payment card, account, social
security and phone numbers, secrets (long hexadecimal strings, key formats) and names after a title. Each is
replaced by a keyed surrogate of its type: characters keep their class, case, script and place in
the format; octets stay octets; a card number that passes the Luhn check gets one that does; a
phone number keeps its country code; a name keeps the gender that its title tells and its script.
The surrogate depends on the key and the entity's normal form alone, but for the spelling's letter
case and separators, so one entity has one surrogate in every document and spelling. The normal form is
lower case or digits only, as the type has it. A phone number's tells whether it began with '+',
for only then it has a country; a name's tells the title's gender, so Mr and Mrs A are two entities.

A name is one or two capitalised words, with hyphens, apostrophes and particles (de, van, von and such, which stay), after a title; a title without
a gender (Dr, Prof) gives an entity of its own. What it does not find: names without one of the titles, later mentions of a name
without its title, IPv6 addresses, postal addresses, dates of birth. Octets above 255 count as an address. These are limits of the patterns, not of the surrogates.

Collision check: the distinct entities of the corpus are counted by type and surrogate (combined
map-side). Where two share a surrogate, or a surrogate equals a real entity, the later one gets the
next attempt's, until none collides. Each attempt's names are a syllable longer and its mail addresses a
letter, so their space outgrows any number of entities within a few rounds. The other types keep their
format's length; where a corpus fills a format, the job fails after MAX_ROUNDS. Only documents that hold such an entity are joined with the
new surrogates; all others are rewritten in the map over the texts. The check keeps its tables on the executors' disks and writes files of
colliding entities alone: Hadoop's local files start a process (chmod) each, which for a moment counts as large as its executor.

Defined cases: null text stays null, empty text empty; repeated rows are rewritten alike; an empty
table gives an empty result. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .staging import drop, staged

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_TITLES_M = r"Mr|Herr|Monsieur|Señor|Sr|Господин"
_TITLES_F = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_TITLES_N = r"Dr|Prof|Professor|Доктор"
_KEYS = r"sk|pk|ghp|gho|xoxb|xoxp"
_PARTICLES = r"(?:(?:de|den|der|di|du|da|del|la|le|ter|van|von|zu) )*+"
_CALLED = r"\p{Lu}(?:\p{L}++|['’]\p{Lu}\p{L}++)(?:[\-'’]\p{Lu}\p{L}++)*+"
#: In this order at each place of a text.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]++\.)+[\p{L}]{2,24}(?![\p{L}\p{N}\-])"),
    ("secret", _EDGE + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:" + _KEYS + r")[_\-][A-Za-z0-9_\-]{16,128})" + _END),
    ("ip", r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"),
    ("iban", _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END),
    ("card", _EDGE + r"(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})" + _END),
    ("ssn", _EDGE + r"\d{3}-\d{2}-\d{4}" + _END),
    ("phone", r"(?<![\p{L}\p{N}+.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3,4}[ .\-]\d{3,4}" + _END + r"|(?<![\p{L}\p{N}+])\+\d{8,15}" + _END),
    ("name", _EDGE + rf"(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.? {_PARTICLES}{_CALLED}(?: {_PARTICLES}{_CALLED})?"),
)
#: A spelled phone number's country code: calling codes are prefix-free, those not listed have three digits.
_COUNTRY = r"^\+(?:1|7|(?:2D[07]|3D[0-469]|4D[013-9]|5D[1-8]|6D[0-6]|8D[1246]|9D[0-58])|[0-9]D[0-9]D[0-9])".replace("D", "[^0-9]*")
#: Rounds of the collision check after which a fixed-length format counts as full.
MAX_ROUNDS = 200
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: No entity without one of these: a digit or an at sign, a title, the head of a key, or a hexadecimal string of letters alone.
HINT = rf"[0-9@]|{_TITLES_M}|{_TITLES_F}|{_TITLES_N}|AKIA|(?:{_KEYS})[_\-]|[a-f]{{32}}|[A-F]{{32}}"


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind, p in reversed(PATTERNS[:-1]):
        out = F.when(value.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def _female(value: Column) -> Column:
    return value.rlike(rf"^(?:{_TITLES_F})[. ]")


def normal(kind: Column, value: Column) -> Column:
    """An entity's spelling-independent form."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    phone = F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits)
    gender = F.when(_female(value), "f ").when(value.rlike(rf"^(?:{_TITLES_N})[. ]"), "n ").otherwise("m ")
    name = F.concat(gender, F.regexp_replace(value, r"^[^ ]+ ", ""))
    return F.when(kind == "email", F.lower(value)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind == "iban", F.translate(value, " ", "")).when(kind == "name", name).otherwise(value)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that depend on all of these."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))


def _number(stream: Column, i: Column | int, digits: int = 2) -> Column:
    """The i-th number of a stream."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(stream, (i * digits) % (256 - digits) + 1, F.lit(digits)), 16, 10).cast("int")


def _from(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


_ACCENTED = "àáâäçèéêëìíîïñòóôöùúûü"
_CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
_GREEK = "αβγδεζηθικλμνξοπρτυφχψω"  # no sigma: its lower case depends on what follows


def _like(c: Column, n: Column) -> Column:
    """A character of c's class, case and script; others stay."""
    low = F.lower(c)
    new = (
        F.when(c.rlike("[0-9]"), _from("0123456789", n))
        .when(low.rlike("[a-z]"), _from("abcdefghijklmnopqrstuvwxyz", n))
        .when(low.rlike(r"\p{IsCyrillic}"), _from(_CYRILLIC, n))
        .when(low.rlike(r"\p{IsGreek}"), _from(_GREEK, n))
        .when(low.rlike(r"\p{IsLatin}"), _from(_ACCENTED, n))
        .otherwise(c)
    )
    return F.when(c == low, new).otherwise(F.upper(new))


def _respell(value: Column, stream: Column, shift: int = 0) -> Column:
    """Every letter and digit by one of its class. The k-th of them takes the stream's k-th number
    whatever stands between."""
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"[^\p{L}\p{N}]", "")) + shift
    return F.array_join(F.transform(F.split(value, "(?!^)(?=.)"), lambda c, i: _like(c, _number(stream, place(i)))), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check of a string of digits."""
    back = F.split(F.reverse(digits), "(?!^)(?=.)")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def streams(key: str, kind: Column, value: Column, norm: Column, attempt: Column) -> list[Column]:
    """What surrogate() draws from, and the attempt. Kept in columns of its own, so it is computed once an entity."""
    domain = F.when(kind == "email", _stream(key, F.lit("domain"), F.lower(F.substring_index(value, "@", -1)), F.lit(0)))
    return [attempt.alias("attempt"), _stream(key, kind, norm, attempt).alias("stream"), domain.alias("domain_stream")]


def _grown(s: Column, attempt: Column, *letters: str) -> Column:
    """As many syllables, of a letter of each set, as there were attempts before; no surrogate of attempt 0 changes."""
    n = len(letters)
    more = F.transform(F.sequence(F.lit(1), attempt), lambda k: F.concat(*(_from(c, _number(s, k * n + 20 + j)) for j, c in enumerate(letters))))
    return F.when(attempt > 0, F.array_join(more, "")).otherwise("")


def surrogate(e: Column) -> Column:
    """e: struct of kind, value, attempt, stream, domain_stream."""
    kind, value, attempt, s, domain_stream = e["kind"], e["value"], e["attempt"], e["stream"], e["domain_stream"]
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 2)
    email = F.concat(_respell(local, s), _grown(s, attempt, "abcdefghijklmnopqrstuvwxyz"), F.lit("@"), _respell(host, domain_stream), F.lit("."), top)
    ip = F.concat_ws(".", *((_number(s, k, 4) % 254 + 1).cast("string") for k in range(4)))
    secret = F.when(value.rlike("^[0-9a-f]+$"), F.substr(s, F.lit(1), F.length(value))).when(value.rlike("^[0-9A-F]+$"), F.upper(F.substr(s, F.lit(1), F.length(value))))
    secret = secret.otherwise(F.concat(F.regexp_extract(value, r"^(AKIA|[a-z]+[_\-])", 1), _respell(F.regexp_replace(value, r"^(AKIA|[a-z]+[_\-])", ""), s)))
    card = _respell(value, s)
    fixed = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), ((F.right(card, F.lit(1)).cast("int") + 10 - _luhn(F.regexp_replace(card, "[^0-9]", "")) % 10) % 10).cast("string"))
    card = F.when(_luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0, fixed).otherwise(card)
    country = F.regexp_extract(value, _COUNTRY, 0)
    phone = F.concat(country, _respell(F.substr(value, F.length(country) + 1, F.length(value)), s))
    iban = F.concat(F.substring(value, 1, 2), _respell(F.substr(value, F.lit(3), F.length(value)), s))
    title, called = F.regexp_extract(value, r"^([^ ]+ )", 1), F.regexp_replace(value, r"^[^ ]+ ", "")
    cyrillic = called.rlike(r"\p{IsCyrillic}")
    words = F.split(called, " ")
    name = F.transform(words, lambda w, i: _given(w, s, i, i == F.size(words) - 1, _female(value), cyrillic, attempt))
    name = F.concat(title, F.array_join(name, " "))
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", _respell(value, s)).otherwise(name)


def _given(word: Column, s: Column, i: Column, last: Column, female: Column, cyrillic: Column, attempt: Column) -> Column:
    """A name of three syllables, the last word's with one more for each attempt before, in the name's script,
    with its gender's ending and the word's letter case."""
    at = i * 10
    latin = [_from(c, _number(s, at + k)) for k, c in enumerate(("BCDFGLMNPRSTV", "aeiou", "bdlmnrstv", "aeiou", "lmnrstdv"))]
    slavic = [_from(c, _number(s, at + k)) for k, c in enumerate(("БВГДКЛМНПРСТ", "аеиоу", "бвдлмнрст", "аеиоу", "лмнрств"))]
    grown = lambda *letters: F.when(last, _grown(s, attempt, *letters)).otherwise("")
    slavic, latin = [*slavic, grown("аеиоу", "лмнрств")], [*latin, grown("aeiou", "lmnrstdv")]
    new = F.when(cyrillic, F.concat(*slavic, F.when(female, "а").otherwise("ов"))).otherwise(F.concat(*latin, F.when(female, "a").otherwise("o")))
    particle = word == F.lower(word)
    return F.when(particle, word).when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(new)


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct kind, norm and one spelling (value) of the corpus: the normal form of its surrogate is that of all spellings'."""
    each = docs.select(F.explode(F.array_distinct(_found(F.col(text_col)))).alias("value"))
    each = each.groupBy("value").agg(F.lit(1).alias("_"))  # each spelling is classed once a task
    each = each.select(kind_of(F.col("value")).alias("kind"), "value")
    return each.select("kind", normal(F.col("kind"), F.col("value")).alias("norm"), "value").groupBy("kind", "norm").agg(F.min("value").alias("value"))


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """df on the executors' disks, computed once, and its number of rows. Lost parts are computed anew."""
    df = df.persist(StorageLevel.DISK_ONLY)
    return df, df.count()


def overrides(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame | None:
    """kind, norm, attempt of the entities whose first surrogate collides, a written table; None if there are none."""
    known, _ = _kept(entities(docs, text_col))
    again, rounds = None, 0
    while True:
        tried = known.withColumn("attempt", F.lit(0)) if again is None else known.join(again, ["kind", "norm"], "left").fillna(0, "attempt")
        tried = tried.select("kind", "norm", F.struct("kind", "value", *streams(key, F.col("kind"), F.col("value"), F.col("norm"), F.col("attempt"))).alias("_e"))
        tried = tried.select("kind", "norm", surrogate(F.col("_e")).alias("new")).select("kind", "norm", normal(F.col("kind"), F.col("new")).alias("new"))
        tried, _ = _kept(tried)
        real = known.select("kind", F.col("norm").alias("new"))
        keep = tried.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("norm").alias("first")).filter("n > 1")
        shared = tried.join(keep, ["kind", "new"]).filter(F.col("norm") != F.col("first")).select("kind", "norm")
        equal = tried.join(real, ["kind", "new"], "left_semi").select("kind", "norm")
        bad, n_bad = _kept(shared.union(equal).distinct().withColumn("attempt", F.lit(1)))
        rounds += n_bad > 0
        if rounds == MAX_ROUNDS:
            raise ValueError(f"entities without a surrogate of their own after {rounds} rounds: {[tuple(r) for r in bad.groupBy('kind').count().collect()]}")
        if n_bad:  # written, so that lineage doesn't grow with the rounds
            before, moved = again, bad if again is None else again.union(bad)
            again = staged(moved.groupBy("kind", "norm").agg(F.sum("attempt").cast("int").alias("attempt")), "entities")
            if before is not None:
                drop(before)
        bad.unpersist()
        tried.unpersist()
        if not n_bad:
            known.unpersist()
            return again


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with every entity of text_col replaced by its surrogate; count_col, if given, counts them."""
    again = overrides(docs, key, text_col)
    # Other columns travel in one struct, so that their names can't clash with the working columns.
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0)]
    wide = docs.select(F.struct(*others).alias("_row"), F.col(f"`{text_col}`").alias("_text"), _found(F.col(f"`{text_col}`")).alias("_found"))
    attempts = F.lit(None).cast("map<string,int>")
    if again is not None:
        wide = _with_attempts(wide, again)
        attempts = F.col("_attempts")

    # One array after the other: kinds, normal forms, streams, surrogates.
    attempt = (lambda k, n: F.coalesce(F.try_element_at(attempts, F.concat_ws("|", k, n)), F.lit(0))) if again is not None else (lambda k, n: F.lit(0))
    steps = (
        lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")),
        lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), normal(e["kind"], e["value"]).alias("norm")),
        lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), *streams(key, e["kind"], e["value"], e["norm"], attempt(e["kind"], e["norm"]))),
        surrogate,
    )
    wide = wide.withColumn("_new", F.col("_found"))
    for step in steps:
        wide = wide.withColumn("_new", F.transform("_new", step))

    between = F.split("_text", ANY, -1)
    text = F.when(F.size("_found") == 0, F.col("_text")).otherwise(F.array_join(F.zip_with("_parts", "_new", lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), ""))
    wide = wide.withColumn("_parts", F.when(F.size("_found") > 0, between))
    names = [text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return wide.select(*names, *([F.size("_found").cast("long").alias(count_col)] if count_col else []))


def _with_attempts(wide: DataFrame, again: DataFrame) -> DataFrame:
    """Adds _attempts, a map from kind|norm, to the rows that hold such an entity."""
    key = F.xxhash64("_text")
    held = wide.filter(F.size("_found") > 0).select(key.alias("_key"), F.explode(F.array_distinct("_found")).alias("value"))
    held = held.select("_key", kind_of(F.col("value")).alias("kind"), "value").select("_key", "kind", normal(F.col("kind"), F.col("value")).alias("norm")).distinct()
    maps = held.join(again, ["kind", "norm"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("_attempts"))
    # A written table's size is known when the join is planned: below the threshold no text is shuffled.
    maps = staged(maps, "attempts")
    drop(again)
    return wide.withColumn("_key", key).join(maps, "_key", "left").drop("_key")
