"""Personal data replaced by keyed surrogates of the same type.

Entities are found by one regular expression. Each distinct entity, in a normal form that joins its spellings, gets
one surrogate derived from a secret key, so equal entities stay equal everywhere (coreference). Numbers and addresses
go through a keyed permutation of their form, so two of one form never clash; surrogates that two entities share all
the same, or that occur as an entity themselves, are derived anew in ever wider forms until none is left
(distinctness). Names that a text gives with a title are replaced in that text without it too; a word of a name has
one surrogate, of the gender that its titles tell. A surrogate then takes on each occurrence's format: digit groups
and separators of numbers, letter case and script of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import written

#: Titles by the gender that they tell.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа")
OTHER_TITLES = ("Dr", "Prof")

_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
#: What tokens of services begin with.
_TOKENS = "AKIA|gh[pousr]_|xox[abprs]-|sk-"
#: Kinds in the order in which they are tried at a place. A name is matched with its title, which tells the gender.
PATTERNS = (
    ("email", "(?<![\\w.+-])[\\w.+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("token", f"(?<![0-9A-Za-z_-])(?:{_TOKENS})[0-9A-Za-z_-]{{16,}}(?![0-9A-Za-z_-])"),
    ("iban", "(?<![0-9A-Za-z])[A-Z]{2}\\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("secret", "(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    ("card", "(?<![\\d.])(?:\\d{13,19}|\\d{4}(?:[ -]\\d{4}){3})(?![\\d]|\\.\\d)"),
    ("phone", "(?<![\\w.+])(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\) ?|\\d{3}[.-])\\d{3}[ .-]\\d{4}(?!\\d)|(?<![\\w.+])\\+\\d(?:[ .-]?\\d){7,14}(?!\\d)"),
    ("ssn", "(?<![\\w-])\\d{3}-\\d{2}-\\d{4}(?![\\w-])"),
    ("ip", f"(?<![\\d.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\d|\\.\\d)"),
    ("name", f"(?<![\\p{{L}}])(?:{_TITLE})\\.? \\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
_NAME = dict(PATTERNS)["name"]
_WITH_TITLE = f"^(?:{_TITLE})\\.? "
#: Rounds of a permutation.
ROUNDS = 8
#: Letters that a mailbox gets more with each attempt, how many at most, and the length that it keeps of its own then.
_MORE_LETTERS, _MOST_LETTERS, _MAILBOX = 4, 40, 20

_LATIN = ("bdfgklmnprstvz", "aeiou")
_CYRILLIC = ("бвгдзклмнпрст", "аеиоу")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _kind(raw: Column) -> Column:
    """Kind of an occurrence, told by its form."""
    out = F.when(raw.contains("@"), "email").when(raw.rlike(f"^(?:{_TOKENS})[0-9A-Za-z_-]{{16,}}$"), "token").when(raw.rlike("^[A-Z]{2}\\d{2}"), "iban")
    out = out.when(raw.rlike("^\\p{Lu}"), "name").when(raw.rlike("^[0-9a-f]{32,64}$"), "secret").when(raw.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "ip")
    out = out.when(raw.rlike("^(?:\\d{13,19}|\\d{4}(?:[ -]\\d{4}){3})$"), "card").when(raw.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn")
    return out.otherwise("phone")


def _units(raw: Column) -> Column:
    """What of an occurrence is replaced each on its own: (kind, norm, gender, given). Of a name, its words, so that a
    name alone and in full goes by the same surrogate; gender is what the title tells, and given words are those before
    the last."""
    title = F.regexp_extract(raw, "^([^ .]+)\\.? ", 1)
    gender = F.when(title.isin(*MALE_TITLES), "m").when(title.isin(*FEMALE_TITLES), "f").otherwise("n")
    words = F.filter(F.split(F.regexp_replace(raw, _WITH_TITLE, ""), " "), lambda w: w != "")

    def word(w: Column, i: Column) -> Column:
        kind = F.when(w.rlike("\\p{IsCyrillic}"), "name:cyrillic").otherwise("name:latin")
        return F.struct(kind.alias("kind"), F.lower(w).alias("norm"), gender.alias("gender"), (i < F.size(words) - 1).alias("given"))

    kind = _kind(raw)
    norm = F.when(kind.isin("email", "secret", "ip"), F.lower(raw)).when(kind == "token", raw)
    norm = norm.when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(_digits(raw))
    other = F.struct(kind.alias("kind"), norm.alias("norm"), F.lit("n").alias("gender"), F.lit(False).alias("given"))
    return F.when(kind == "name", F.transform(words, word)).otherwise(F.array(other))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Hexadecimal stream of an entity and attempt, 128 bytes long."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat_ws("\x1f", seed, F.lit(str(block))), 256) for block in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(2 * i, F.lit(256)) + 1, F.lit(2)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    values = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _permuted(key: str, tweak: Column, left: Column, left_size: Column, right: Column, right_size: Column) -> Column:
    """Struct (l, r) of a keyed permutation of the pairs left below left_size, right below right_size: in turn each half
    moves on by a hash of the other, which can be undone, so no two pairs give the same one."""

    def ahead(i: Column, half: Column) -> Column:
        text = F.concat_ws("\x1f", F.lit(key), tweak, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_l, moved_r = F.pmod(s["l"] + ahead(i, s["r"]), left_size), F.pmod(s["r"] + ahead(i, s["l"]), right_size)
        return F.struct(F.when(even, moved_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved_r).alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits_permuted(key: str, tweak: Column, digits: Column) -> Column:
    """Digits (up to 30) by a keyed permutation of all strings of as many."""
    half = F.floor(F.length(digits) / 2).cast("int")
    other = F.length(digits) - half
    sides = [F.coalesce(F.substring(digits, start, n).try_cast("long"), F.lit(0)) for start, n in ((F.lit(1), half), (half + 1, other))]
    sizes = [F.round(F.pow(F.lit(10.0), n)).cast("long") for n in (half, other)]
    out = _permuted(key, F.concat_ws("\x1f", tweak, F.length(digits).cast("string")), sides[0], sizes[0], sides[1], sizes[1])
    return F.concat(F.lpad(out["l"].cast("string"), half, F.lit("0")), F.lpad(out["r"].cast("string"), other, F.lit("0")))


def _number(key: str, kind: Column, digits: Column, attempt: Column) -> Column:
    """Digits permuted: first those after the first, then all, then with more digits behind."""
    inner = _digits_permuted(key, F.concat_ws("\x1f", kind, F.substring(digits, 1, 1)), F.substring(digits, F.lit(2), F.length(digits)))
    longer = F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), attempt - 1)))
    whole = _digits_permuted(key, F.concat_ws("\x1f", kind, attempt.cast("string")), longer)
    return F.when(attempt == 0, F.concat(F.substring(digits, 1, 1), inner)).otherwise(whole)


def _address(key: str, norm: Column, attempt: Column) -> Column:
    """An address of the same network: of 192.168.0.0/16, or else of the same first octet; then 192.168.0.0/16 in
    10.0.0.0/8 and others anywhere; then in the documentation block of IPv6, a part of it for each attempt."""
    octets = [F.split_part(norm, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    local = norm.startswith("192.168.")

    def two(tweak: str, left: Column, left_size: int, right: Column, right_size: int) -> Column:
        return _permuted(key, F.concat(F.lit(f"ip {tweak} "), attempt.cast("string")), left, F.lit(left_size), right, F.lit(right_size))

    def dotted(value: Column, count: int) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(value, 8 * i), F.lit(256)).cast("string") for i in reversed(range(count))])

    small = two("16", octets[2], 256, octets[3], 256)
    same = F.concat(F.lit("192.168."), F.concat_ws(".", small["l"].cast("string"), small["r"].cast("string")))
    inner = _permuted(key, F.concat(F.lit("ip 24 "), F.split_part(norm, F.lit("."), F.lit(1))), octets[1] * 16 + F.floor(octets[2] / 16), F.lit(4096), F.pmod(octets[2], F.lit(16)) * 256 + octets[3], F.lit(4096))
    class_a = F.concat(F.split_part(norm, F.lit("."), F.lit(1)), F.lit("."), dotted(inner["l"] * 4096 + inner["r"], 3))
    ten = two("10", octets[2], 4096, octets[3], 4096)
    full = two("32", octets[0] * 256 + octets[1], 65536, octets[2] * 256 + octets[3], 65536)
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(attempt.cast("long"))), F.lit("::"), F.lower(F.hex(full["l"])), F.lit(":"), F.lower(F.hex(full["r"])))
    first = F.when(local, same).otherwise(class_a)
    second = F.when(local, F.concat(F.lit("10."), dotted(ten["l"] * 4096 + ten["r"], 3))).otherwise(dotted(full["l"] * 65536 + full["r"], 4))
    return F.when(attempt == 0, first).when(attempt == 1, second).otherwise(v6)


def surrogate(key: str, kind: Column, norm: Column, form: Column, attempt: Column) -> Column:
    """Surrogate of an entity in normal form, for an attempt; form is the gender that a name's ending shows (m, f, n).

    Each attempt has more values to choose from than the one before (numbers get more digits, mailboxes and names more
    letters, addresses larger networks), so that clashes run out whatever entities there are."""
    stream = _stream(key, kind, norm, attempt)

    def like(c: Column, i: Column) -> Column:
        value = _byte(stream, i)
        digit = (value % 10).cast("string")
        lower = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), value % 26 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("\\p{Lu}"), F.upper(lower)).when(c.rlike("\\p{L}"), lower).otherwise(c)

    def alike(text: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), like), "")

    # the mailbox keeps its shape; a domain's surrogate depends on the domain alone
    mailbox, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 10)
    # bytes that no character of a mailbox uses
    letters = F.transform(F.sequence(F.lit(0), F.least(F.lit(_MOST_LETTERS), _MORE_LETTERS * attempt) - 1), lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(stream, 70 + n) % 26 + 1, F.lit(1)))
    own = F.when(attempt > 0, F.concat(F.substring(alike(mailbox), 1, _MAILBOX), F.array_join(letters, ""))).otherwise(alike(mailbox))
    email = F.concat(own, F.lit("@mail"), host, F.lit(".example"))

    numbers = _number(key, kind, norm, attempt)
    # a card's last digit stays as far from the one that passes the Luhn check as it was, so one that passed passes
    def check_digit(body: Column) -> Column:
        return F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))

    body = F.substring(norm, F.lit(1), F.length(norm) - 1)
    off = F.pmod(F.substring(norm, F.length(norm), F.lit(1)).cast("int") - check_digit(body), F.lit(10))
    new_body = _number(key, kind, body, attempt)
    card = F.concat(new_body, F.pmod(check_digit(new_body) + off, F.lit(10)).cast("string"))

    secret = F.substring(stream, F.lit(1), F.length(norm))
    prefix = F.regexp_extract(norm, f"^({_TOKENS})", 1)
    token = F.concat(prefix, alike(F.substring(norm, F.length(prefix) + 1, F.length(norm))))
    # the check digits of an account number: 98 less the rest by 97 of the digits, letters counting from 10 on
    account, country = alike(F.substring(norm, F.lit(5), F.length(norm))), F.substring(norm, 1, 2)
    values = F.transform(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    iban = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)

    def name(letters: tuple[str, str], endings: dict[str, str]) -> Column:
        hard, soft = letters
        syllables = F.transform(
            F.sequence(F.lit(0), F.least(F.lit(60), 2 + attempt)),
            lambda i: F.concat(
                F.substring(F.lit(hard), _byte(stream, 2 * i) % len(hard) + 1, F.lit(1)),
                F.substring(F.lit(soft), _byte(stream, 2 * i + 1) % len(soft) + 1, F.lit(1)),
            ),
        )
        ending = F.when(form == "f", endings["f"]).when(form == "m", endings["m"]).otherwise(endings["n"])
        return F.concat(F.array_join(syllables, ""), ending)

    latin = name(_LATIN, {"f": "na", "m": "rd", "n": "n"})
    cyrillic = name(_CYRILLIC, {"f": "ова", "m": "ов", "n": "ко"})
    out = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "card", card).when(kind == "ip", _address(key, norm, attempt))
    out = out.when(kind == "token", token).when(kind == "iban", iban)
    return out.when(kind.startswith("name"), F.when(kind.endswith("cyrillic"), cyrillic).otherwise(latin)).otherwise(numbers)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct entities (kind, norm, and form if there is such a column): of one kind, no
    two share a surrogate, and none is itself an entity. In each round the losers of a clash (all but the least norm)
    are derived anew, in a wider form each time (see surrogate), so every entity gets one."""
    form = F.col("form") if "form" in entities.columns else F.lit("n")
    open_rows = written(entities.select("kind", "norm", form.alias("form")).distinct().withColumn("attempt", F.lit(0)))
    # names of all scripts, and numbers of all kinds, are one family each
    family = F.when(F.col("kind").startswith("name"), "name").when(F.col("kind").isin("phone", "ssn", "card"), "number").otherwise(F.col("kind"))
    originals = open_rows.select(family.alias("family"), F.col("norm").alias("surrogate")).distinct()
    done = None
    while True:
        tried = open_rows.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("norm"), F.col("form"), F.col("attempt"))).withColumn("family", family)
        winners = tried.groupBy("family", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("winner"))
        judged = tried.join(winners, ["family", "surrogate"])
        taken = originals.withColumn("taken", F.lit(True))
        if done is not None:
            taken = taken.unionAll(done.select(family.alias("family"), "surrogate", F.lit(True).alias("taken")))
        judged = judged.join(taken.distinct(), ["family", "surrogate"], "left")
        good = F.col("taken").isNull() & (F.col("winner.norm") == F.col("norm")) & (F.col("winner.kind") == F.col("kind"))
        judged = written(judged.select("kind", "norm", "form", "attempt", "surrogate", good.alias("good")))
        kept = judged.filter("good").select("kind", "norm", "surrogate")
        done = kept if done is None else done.unionAll(kept)
        open_rows = judged.filter("NOT good").select("kind", "norm", "form", (F.col("attempt") + 1).alias("attempt"))
        if open_rows.isEmpty():
            return done


def _poured(raw: Column, places: str, characters: Column) -> Column:
    """What of `raw` matches `places` replaced by `characters`, in order; what is left of them follows."""
    between = F.split(raw, places, -1)
    filled = F.array_join(F.transform(between, lambda gap, i: F.concat(gap, F.substring(characters, i + 1, F.lit(1)))), "")
    return F.concat(filled, F.substring(characters, F.size(between) + 1, F.length(characters)))


def _rendered(raw: Column, parts: Column) -> Column:
    """An occurrence in its own format, from its units' surrogates."""
    kind = _kind(raw)
    title = F.regexp_extract(raw, f"({_WITH_TITLE})", 1)
    words = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), " ")
    first = F.element_at(parts, 1)
    email = F.when(raw == F.upper(raw), F.upper(first)).otherwise(first)
    out = F.when(kind == "name", F.concat(title, words)).when(kind == "email", email).when(kind.isin("secret", "ip", "token"), first)
    return out.when(kind == "iban", _poured(raw, "[0-9A-Z]", first)).otherwise(_poured(raw, "[0-9]", first))


def _names(text: Column, titled: Column) -> Column:
    """Names that a text gives with a title, without it; texts that aren't titled are not searched."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda n: F.regexp_replace(n, _WITH_TITLE, ""))
    return F.when(titled, found).otherwise(F.array().cast("array<string>"))


def _pattern(names: Column) -> Column:
    """ANY, and these names and each of their words without a title."""
    forms = F.array_distinct(F.concat(names, F.flatten(F.transform(names, lambda n: F.split(n, " ")))))
    own = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}])(?:"), F.array_join(forms, "|"), F.lit(")(?![\\p{L}])"))
    return F.when(F.size(names) > 0, own).otherwise(F.lit(ANY))


def replace_personal_data(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, entities (number replaced).

    Kinds: e-mail addresses, tokens of services, IBANs, hexadecimal secrets of 32 to 64 digits, card numbers, phone
    numbers, social security numbers, IPv4 addresses, and names after a title, which are replaced wherever they stand
    in that text. Null texts stay null and empty texts empty, with 0 entities; texts without entities come back as they
    are. Repeated rows, null ids and copies get the same surrogates; an empty table gives an empty result; other
    columns are not read. `key` must not be empty: the surrogates are only as secret as it is.
    """
    if not key:
        raise ValueError("a secret key is needed")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # plain substrings first: most texts have neither a digit nor @ nor a title, and need no search by ANY
    titled = F.lit(False)
    for title in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES):
        titled = titled | F.col("text").contains(title)
    hint = F.col("text").rlike("[0-9@]") | F.col("text").contains("sk-") | titled
    hit = F.coalesce(hint & F.col("text").rlike(ANY), F.lit(False))
    hits = rows.filter(hit).withColumn("digest", F.sha2("text", 256)).withColumn("names", _names(F.col("text"), titled))
    hits = hits.withColumn("pattern", _pattern(F.col("names"))).drop("names")
    # copies share their row of occurrences; only short strings go through the shuffles up to the last
    found = hits.select("digest", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("raws"))
    found = found.select("digest", F.posexplode("raws").alias("at", "raw")).distinct()
    found = written(found.select("digest", "at", "raw", F.posexplode(_units(F.col("raw"))).alias("part", "unit")).select("digest", "at", "raw", "part", "unit.*"))
    # the gender of a name's word, from all its titles; family names show it in Cyrillic only
    entities = found.groupBy("kind", "norm").agg(
        F.bool_or(F.col("gender") == "m").alias("m"), F.bool_or(F.col("gender") == "f").alias("f"), (F.bool_or("given") | F.col("kind").endswith("cyrillic")).alias("shown")
    )
    form = F.when(F.col("shown") & F.col("m") & ~F.col("f"), "m").when(F.col("shown") & F.col("f") & ~F.col("m"), "f").otherwise("n")
    named = surrogates(entities.select("kind", "norm", form.alias("form")), key)
    filled = found.select("digest", "at", "raw", "part", "kind", "norm").join(named, ["kind", "norm"])
    # the units of an occurrence, then the occurrences of a text, in order; both are bounded by the text's length
    unit = F.sort_array(F.collect_list(F.struct("part", "surrogate")))
    filled = filled.groupBy("digest", "at", "raw").agg(unit.alias("units"))
    filled = filled.select("digest", "at", _rendered(F.col("raw"), F.col("units.surrogate")).alias("new"))
    filled = filled.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("new"))
    joined = hits.join(filled, "digest")
    gaps = F.split("text", F.col("pattern"), -1)
    text = F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("new.new"), i), F.lit("")))), "")
    changed = joined.select("id", text.alias("text"), F.size("new").alias("entities"))
    same = rows.filter(~hit).select("id", "text", F.lit(0).alias("entities"))
    return changed.unionAll(same).select(F.col("id").alias(id_column), F.col("text").alias(text_column), "entities")
