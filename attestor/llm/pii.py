"""Personal data replaced by keyed surrogates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.session import Workspace

_LABEL = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)"
_GAP = r"[ .()%*#$&|!-]"
_MALE = r"Mr|Herr|Señor|Sr|Monsieur|Don"
_FEMALE = r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Doña"
_EITHER = r"Dr|Prof"


def _named(titles: str) -> str:
    """A name word after a title, or the word after that one; the cheap tests come first."""
    return rf"(?<= )(?=\p{{Lu}})(?<=\b(?:{titles})\.? (?:\p{{Lu}}[\p{{L}}'-]{{1,24}} )?)\p{{Lu}}[\p{{L}}'-]{{1,24}}"


_NAMES = {"name_m": _MALE, "name_f": _FEMALE, "name_n": _EITHER}
#: Kinds in the order in which they are tried at a place of the text, each with its pattern.
PATTERNS = {
    "secret": rf'(?<=["\'])(?<=(?i:{_LABEL})[^\w"\']{{0,8}}["\'])[^\s"\']{{8,}}(?=["\'])|(?<![0-9A-Za-z])(?=[0-9a-fA-F]{{32}})(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}})(?![0-9A-Za-z])',
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9_][\p{L}0-9._%+-]{0,63}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+)+",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": rf"(?=[+(\d])(?:(?<![\w+])\+\d{{1,3}}{_GAP}{{0,7}}\d{{2,4}}{_GAP}{{1,7}}\d{{3,4}}{_GAP}{{1,4}}\d{{3,4}}(?!\d)|(?<![\d(])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-]))",
    "card": r"(?=\d)(?<![\d.,])\d(?:[ -]?\d){12,18}(?!\d)",
} | {kind: _named(titles) for kind, titles in _NAMES.items()}
#: What every entity holds something of: a text without it is not searched further.
SIGN = rf"[0-9@\"']|(?=[MHSDFP])\b(?:{_MALE}|{_FEMALE}|{_EITHER})\b|(?<![0-9A-Za-z])[a-fA-F]{{32}}"
TITLE = rf"(?=[MHSDFP])\b(?:{_MALE}|{_FEMALE}|{_EITHER})\b"
#: Any entity; the names of each gender are its three groups.
ENTITY = "|".join(f"({p})" if kind in _NAMES else f"(?:{p})" for kind, p in PATTERNS.items())


def found_entities(text: Column) -> Column:
    """The entities of a text in order, other than names without title."""
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def _groups(text: Column, pattern: Column) -> list[Column]:
    """For each entity the name it is by each title's gender, else the empty string."""
    return [F.regexp_extract_all(text, pattern, F.lit(i + 1)) for i in range(len(_NAMES))]


def _with_mentions(rows: DataFrame) -> DataFrame:
    """Add ``list``, (kind, value) of every entity of ``body`` in order, and ``pieces``, the text around them.

    A name that stands after a title is also found where it stands without one. The kind is that of the title it was found by;
    a title of either gender, or none, takes the gender that the name has elsewhere in the text: of two,
    the one of the earliest title.
    """
    titled = F.col("body").rlike(TITLE)
    plain = F.lit(ENTITY)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("g", F.when(titled, F.array(*_groups(F.col("body"), plain))))
    known = lambda g, i: F.coalesce(F.filter(g[i], lambda v: v != ""), none)
    rows = rows.withColumns({"m": known(F.col("g"), 0), "f": known(F.col("g"), 1), "n": known(F.col("g"), 2)})
    rows = rows.withColumns({"titles": F.zip_with(F.coalesce(F.col("g")[0], none), F.coalesce(F.col("g")[1], none), lambda a, b: F.concat(a, b)), "names": F.array_distinct(F.concat("m", "f", "n"))})
    again = F.concat(F.lit(f"{ENTITY}|(?<![\\p{{L}}'-])(?:"), F.array_join("names", "|"), F.lit(")(?![\\p{L}'-])"))
    rows = rows.withColumn("pattern", F.when(F.size("names") > 0, again).otherwise(plain))
    own = F.array(*_groups(F.col("body"), F.col("pattern")))
    rows = rows.withColumns({"found": F.when(F.size("names") > 0, F.regexp_extract_all("body", "pattern", F.lit(0))).otherwise(F.col("found")), "own": F.when(F.size("names") > 0, own), "pieces": F.split("body", F.col("pattern"), -1)})

    def kind(value: Column, i: Column) -> Column:
        male, female = F.array_contains("m", value), F.array_contains("f", value)
        first = F.array_position("titles", value)
        earliest = F.when(F.coalesce(F.get(F.col("g")[0], (first - 1).cast("int")), F.lit("")) == value, "name_m").otherwise("name_f")
        by_title = F.when(F.get(F.col("own")[0], i) != "", "name_m").when(F.get(F.col("own")[1], i) != "", "name_f")
        return (
            F.when(F.col("own").isNull(), _kind(value))
            .when(by_title.isNotNull(), by_title)
            .when(~F.array_contains("names", value), _kind(value))
            .when(male & female, earliest)
            .when(male, "name_m")
            .when(female, "name_f")
            .otherwise("name_n")
        )

    out = rows.withColumn("list", F.transform("found", lambda v, i: F.struct(kind(v, i).alias("kind"), v.alias("value"))))
    return out.drop("g", "m", "f", "n", "titles", "names", "pattern", "own", "found")


def _kind(value: Column) -> Column:
    """The kind of an entity that is no name."""
    digits = F.regexp_replace(value, r"\D", "")
    out = F.when(value.rlike("^[^@ ]+@[^@ ]+$"), "email")
    out = out.when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{12,}$"), "iban")
    out = out.when(value.rlike(r"^(\+|\()") | value.rlike(r"^\d{3}-\d{3}-\d{4}$"), "phone").when(value.rlike(r"^[\d -]+$") & F.length(digits).between(13, 19), "card")
    return out.otherwise("secret")


def _norm(kind: Column, value: Column) -> Column:
    """What two spellings of one entity have in common."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .otherwise(F.lower(value))
    )


#: Ranges of code points whose letters or digits stand for each other; the first that holds a character is its own.
_RANGES = [
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x66), (0x67, 0x7A), (0xE0, 0xF6), (0xF8, 0xFF), (0x3B1, 0x3C9), (0x430, 0x44F), (0x450, 0x45F), (0x561, 0x586), (0x5D0, 0x5EA),
    (0x641, 0x64A), (0x621, 0x63A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: By gender the end of a name in Latin, Cyrillic and Greek letters; other scripts take none.
_GENDER = {"name_m": ("no", "но", "νο"), "name_f": ("na", "на", "να"), "name_n": ("ne", "не", "νε")}
#: Half rounds of the permutation, and tries to find an entity a surrogate that is no entity itself.
HALF_ROUNDS, TRIES = 4, 12
_FIXED_LENGTH = ("ip", "iban", "ssn", "phone", "card")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cells(kind: Column, text: Column) -> Column:
    """The characters of a normal form (octets of an address) with their value, and the number of values in their class; 1 where a character stays.

    The class of a character depends on itself, and what stays on what stays: so texts that differ in either never meet.
    """
    small = F.lit(None).cast("string")

    def cell(c: Column, v: Column, size: Column, alphabet: Column = small, low: Column | None = None) -> Column:
        return F.struct(c.alias("c"), v.cast("long").alias("v"), (F.lit(0) if low is None else low).cast("int").alias("low"), size.cast("long").alias("size"), alphabet.alias("alphabet"))

    n = F.length(text)
    tail = F.when(kind == "email", n - F.length(F.substring_index(text, ".", -1))).otherwise(n)
    head = F.when(kind == "card", 1).when(kind == "phone", F.greatest(n - 10, F.lit(0))).when(kind == "iban", 2).otherwise(0)

    def of(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        found = cell(c, F.lit(0), F.lit(1))
        for low, high in reversed(_RANGES):
            found = F.when(code.between(low, high), cell(c, code - low, F.lit(high - low + 1), low=F.lit(low))).otherwise(found)
        for letters in (_VOWELS, _CONSONANTS):
            found = F.when(kind.startswith("name") & F.lit(letters).contains(c), cell(c, F.instr(F.lit(letters), c) - 1, F.lit(len(letters)), F.lit(letters))).otherwise(found)
        return F.when((i < head) | (i >= tail), cell(c, F.lit(0), F.lit(1))).otherwise(found)

    octets = F.transform(F.split(text, r"\."), lambda o: cell(o, o.cast("int"), F.lit(256)))
    return F.when(kind == "ip", octets).otherwise(F.transform(F.split(text, ""), of))


def _permuted(cells: Column, seed: Column) -> Column:
    """A keyed permutation of all texts with the same classes.

    In each half round the cells at even (then odd) places are moved within their class by what a digest of all others tells, which
    can be undone as the others are still there. So no two texts come to be one.
    """
    def half(r: int):
        mine = r % 2

        def moved(c: Column, i: Column, told: Column) -> Column:
            step = F.conv(F.substring(F.sha2(F.concat(told, F.lit("|"), i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.when((i % 2 == mine) & (c["size"] > 1), c.withField("v", (c["v"] + step) % c["size"])).otherwise(c)

        def apply(now: Column) -> Column:
            rest = F.filter(now, lambda c, i: i % 2 != mine)
            told = F.sha2(F.concat(seed, F.lit(f"|{r}|"), F.array_join(F.transform(rest, lambda c: F.concat(c["v"].cast("string"), F.lit("/"), c["size"].cast("string"))), ",")), 256)
            return _let(told, lambda told: F.transform(now, lambda c, i: moved(c, i, told)))

        return apply

    for r in range(HALF_ROUNDS):
        cells = _let(cells, half(r))
    return cells


def _written(kind: Column, cells: Column) -> Column:
    wide = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def char(c: Column) -> Column:
        return F.when(kind == "ip", c["v"].cast("string")).when(c["size"] == 1, c["c"]).when(c["alphabet"].isNotNull(), F.substring(c["alphabet"], c["v"].cast("int") + 1, F.lit(1))).otherwise(wide(c["low"] + c["v"]))

    return F.call_function("array_join", F.transform(cells, char), F.when(kind == "ip", ".").otherwise(""))


def _luhn_digit(body: Column) -> Column:
    """The digit that makes a number of these leading digits pass the Luhn check."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    return F.get(F.filter(digits, lambda d: F.call_function("luhn_check", F.concat(body, d))), F.lit(0)).cast("int")


def _iban_digits(country: Column, body: Column) -> Column:
    """The check number of an account: 98 less the remainder by 97, letters counting from 10."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.lit(98) - F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda acc, c: step(acc, c).cast("int"))


def surrogate(kind: Column, text: Column, key: str, tweak: Column) -> Column:
    """The replacement of a normal form, in normal form itself; different forms of a kind have different ones.

    Characters stay in their class (digits, letters of a script, vowels and consonants of Latin names), an address keeps its
    top-level domain, a phone number what precedes its last ten digits, a card its first digit, an account its country. Check
    digits are computed anew and stand as far from right as before, so right ones stay right. A name gets two more letters, by its gender.
    """
    seed = F.concat_ws("|", F.lit(key), kind, tweak.cast("string"))
    front, last = F.substring(text, F.lit(1), F.length(text) - 1), F.substring(text, -1, 1).cast("int")
    country, stated, body = F.substring(text, 1, 2), F.substring(text, 3, 2).cast("int"), F.substring(text, F.lit(5), F.length(text))
    part = F.when(kind == "card", front).when(kind == "iban", F.concat(country, body)).otherwise(text)

    def whole(new: Column) -> Column:
        card = F.concat(new, F.pmod(_luhn_digit(new) + last - _luhn_digit(front), F.lit(10)).cast("string"))
        account = F.substring(new, F.lit(3), F.length(new))
        check = F.pmod(_iban_digits(country, account) + stated - _iban_digits(country, body), F.lit(100))
        out = F.when(kind == "card", card).when(kind == "iban", F.concat(country, F.lpad(check.cast("string"), 2, "0"), account))
        for name, ends in _GENDER.items():
            for script, end in zip(("[a-z]", r"\p{IsCyrillic}", r"\p{IsGreek}"), ends, strict=True):
                out = out.when((kind == name) & new.rlike(script), F.concat(new, F.lit(end)))
        return out.otherwise(new)

    return _let(_written(kind, _permuted(_cells(kind, part), seed)), whole)


def _grown(kind: Column, norm: Column, n: int) -> Column:
    more = F.lit("a" * n)
    return F.when(kind == "email", F.concat(F.substring_index(norm, "@", 1), more, F.lit("@"), F.substring_index(norm, "@", -1))).otherwise(F.concat(norm, more))


def distinct_surrogates(entities: DataFrame, key: str, work: Workspace) -> DataFrame:
    """(kind, norm, surrogate) in which no two entities of a kind share a surrogate and none is an entity of its kind.

    Each kind is permuted, so surrogates differ by construction, however many there are and however few a format allows. One that
    is an entity of the table itself (or stays as it was) is replaced: what is permuted then is no entity but the normal
    form grown by as many letters as tries were made, or, where a format has a fixed length, the form permuted by another key.
    These inputs are no entities either, nor inputs of another, so they too come out distinct. Only such entities are tried
    again, and a longer form leaves 26 times the room. A format of fixed length nearly all of which is in the table keeps,
    after TRIES, the surrogate it had: distinct, yet somebody else's value.
    """
    real = work.save(entities.select("kind", "norm").distinct(), "entities")
    known = real.select(F.col("kind").alias("k"), F.col("norm").alias("n"))
    is_real = lambda rows, column: rows.join(known, (F.col("kind") == F.col("k")) & (F.col(column) == F.col("n")), "left").withColumn(f"{column}_is", F.col("n").isNotNull()).drop("k", "n")
    first = real.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), key, F.lit(0)))
    first = work.save(is_real(first, "surrogate"), "surrogates0")
    done, pending = [first.where("not surrogate_is").select("kind", "norm", "surrogate")], first.where("surrogate_is").select("kind", "norm", "surrogate")
    used = None
    for t in range(1, TRIES + 1):
        if pending.isEmpty():
            return _union(done)
        fresh = F.when(F.col("kind").isin(*_FIXED_LENGTH), surrogate(F.col("kind"), F.col("norm"), key, F.lit(t))).otherwise(_grown(F.col("kind"), F.col("norm"), t))
        tried = pending.withColumnRenamed("surrogate", "before").withColumn("input", fresh).withColumn("surrogate", surrogate(F.col("kind"), F.col("input"), key, F.lit(0)))
        tried = is_real(is_real(tried, "input"), "surrogate").withColumn("free", ~F.col("input_is") & ~F.col("surrogate_is"))
        if used is not None:
            taken = used.select(F.col("kind").alias("k"), F.col("input").alias("i"))
            tried = tried.join(taken, (F.col("kind") == F.col("k")) & (F.col("input") == F.col("i")), "left").withColumn("free", F.col("free") & F.col("i").isNull())
        tried = work.save(tried.select("kind", "norm", "before", "input", "surrogate", "free"), f"surrogates{t}")
        done.append(tried.where("free").select("kind", "norm", "surrogate"))
        pending = tried.where("not free").select("kind", "norm", F.col("before").alias("surrogate"))
        now = tried.where("free").select("kind", "input")
        used = now if used is None else used.unionAll(now)
    return _union([*done, pending])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _in_format(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate written as this occurrence is: its separators, its letter case."""
    spaced = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(
            F.when(kind == "iban", c.rlike("[A-Z0-9]")).otherwise(c.rlike("[0-9]")),
            F.struct(F.concat(acc.out, F.substring(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc["at"].alias("at"))),
        lambda acc: acc.out,
    )
    cased = F.when(value == F.upper(value), F.upper(new)).when(value == F.lower(value), new).when(kind.startswith("name"), F.initcap(new)).otherwise(
        F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    )
    return F.when(kind == "ip", new).when(kind.isin("phone", "card", "ssn", "iban"), spaced).otherwise(cased)


def replace_pii(df: DataFrame, key: str, text_col: str = "text", out_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``df`` with the entities of ``text_col`` replaced in ``out_col``, and their number in ``count_col``.

    Kinds: secrets (quoted after a label, or long hexadecimal), e-mail addresses, IPv4 addresses, IBANs, US social
    security numbers, phone numbers, numbers of 13 to 19 digits (cards), and names after a title with their other
    mentions in the text; a name that never follows a title is not known as one. The
    replacement depends on the key and the entity's normal form alone, so all mentions agree, in every
    document and spelling. It keeps kind, separators, letter case and script; a card keeps its
    first digit and whether its Luhn check holds, an IBAN its country and whether its check number does, a phone number its country code, an address its top-level
    domain, a name the gender its title tells, so that two persons of one name and different titles stay two. Length is
    kept too, but for two letters more that tell the gender of names, and letters added where the same length would be an entity of the table
    (see distinct_surrogates()). Letters of scripts without a range of their own here stay as they are.

    Every text is searched once and written with what was found; texts without entities are never shuffled. Null texts
    stay null and count 0; empty and very long texts, repeated rows and ties are no special case; other columns,
    whatever their names, pass through; an existing ``out_col`` or ``count_col`` is replaced; an empty table
    gives an empty table.
    """
    work = Workspace(df.sparkSession, "pii")
    base = work.save(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), found_entities(F.col(text_col)).alias("found")), "found")
    base = base.withColumn("body", F.col("row")[text_col])
    has = F.coalesce(F.size("found") > 0, F.lit(False))
    marked = work.save(_with_mentions(base.where(has)).drop("body").withColumn("key", F.sha2(F.to_json("list"), 256)), "marked")
    lists = work.save(marked.groupBy("key").agg(F.first("list").alias("list")), "lists")
    mentions = lists.select("key", F.posexplode("list").alias("pos", "e")).select("key", "pos", "e.kind", "e.value", _norm(F.col("e.kind"), F.col("e.value")).alias("norm"))
    known = distinct_surrogates(mentions.select("kind", "norm").distinct(), key, work)
    met = mentions.join(known, ["kind", "norm"]).select("key", F.struct("pos", _in_format(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new")).alias("part"))
    news = work.save(met.groupBy("key").agg(F.transform(F.sort_array(F.collect_list("part")), lambda p: p.new).alias("new")), "replacements")

    text = F.array_join(F.zip_with("pieces", "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = marked.join(news, "key").select("row", text.alias("body"), F.size("list").alias("n"))
    same = base.where(~has).select("row", "body", F.lit(0).alias("n"))
    fresh = {out_col: F.col("body")} | ({} if count_col is None else {count_col: F.col("n")})
    old = [c for c in df.columns if c != count_col]
    columns = [fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in old]
    return same.unionAll(changed).select(*columns, *[v.alias(c) for c, v in fresh.items() if c not in old])
