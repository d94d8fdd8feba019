from __future__ import annotations

import random
import re

import regex

from attestor.llm.pii import PATTERNS, replace_pii

LUHN = "4539 1488 0343 6467"
TEXTS = [
    (1, "Write to Anna.Berg@example.com or call (555) 123-4567."), (2, "ANNA.BERG@EXAMPLE.COM wrote from 10.20.30.40, SSN 123-45-6789"), (3, f"card {LUHN} and {LUHN.replace(' ', '')} again"),
    (4, "Mr. Johnson met Mrs. Smith and Dr. Иванов; Mr. Johnson left"), (5, "IBAN DE89 3704 0044 0532 0130 00"), (6, 'api_key = "sk9Zq8-Example_77"'), (7, "nothing here at all"), (8, None), (9, ""),
    (10, "plain words " * 20_000 + "bob@corp.example " + "more words " * 20_000), (11, "+49 30 1234 5678 and 555-123-4567"), (11, "+49 30 1234 5678 and 555-123-4567"), (None, "bob@corp.example"),
    (12, "numbers 1234 and 3.14 and 2024-01-02 stay, as v1.2.3 does"), (13, "hash " + "0123456789abcdef" * 2),
]


def run(spark, rows, key="k"):
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, kind string, found int")
    return df, replace_pii(df, key)


def test_surrogates_keep_type_format_and_coreference(spark):
    df, out = run(spark, TEXTS)
    assert out.columns == [*df.columns, "n_entities"]
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(r.kind == "clash" and r.found == 3 for r in rows)
    by = {r.doc_id: r for r in rows}
    mail = re.search(r"[A-Za-z]{4}\.[A-Za-z]{4}@[a-z]{7}\.com", by[1].text).group()
    assert mail.lower() != "anna.berg@example.com" and mail[0].isupper() and mail.upper() in by[2].text
    assert re.fullmatch(r"Write to \S+ or call \(\d{3}\) \d{3}-\d{4}\.", by[1].text) and "123-4567" not in by[1].text
    assert re.search(r"from \d+\.\d+\.\d+\.\d+, SSN \d{3}-\d{2}-\d{4}$", by[2].text) and "10.20.30.40" not in by[2].text and "123-45-6789" not in by[2].text
    cards = re.findall(r"\d{4}(?: ?\d{4}){3}", by[3].text)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] != LUHN.replace(" ", "") and cards[0].count(" ") == 3
    digits = [int(c) for c in cards[1]][::-1]
    assert cards[1][0] == "4" and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    m = re.fullmatch(r"Mr\. (\w+) met Mrs\. (\w+) and Dr\. (\w+); Mr\. (\w+) left", by[4].text)
    assert m and m[1] == m[4] and len({m[1], m[2], m[3]}) == 3 and m[1].istitle() and re.fullmatch("[А-Яа-я]+", m[3])
    assert re.fullmatch(r"IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", by[5].text) and "0532" not in by[5].text
    assert re.fullmatch(r'api_key = "[a-z]{2}\d[A-Z][a-z]\d-[A-Z][a-z]{6}_\d\d"', by[6].text) and "sk9Zq8" not in by[6].text
    assert "1234 5678" not in by[11].text and by[11].text.startswith("+49 ")
    assert re.fullmatch("hash [0-9a-f]{32}", by[13].text) and by[13].text != TEXTS[-1][1]
    bob = by[None].text
    assert bob != "bob@corp.example" and by[10].text == TEXTS[9][1].replace("bob@corp.example", bob)
    for i in (7, 8, 9, 12):
        assert by[i].text == dict(TEXTS)[i] and by[i].n_entities == 0
    assert [by[i].n_entities for i in (1, 2, 3, 4, 11)] == [2, 3, 2, 4, 2]


def test_same_key_same_surrogates(spark):
    first, again, other = (sorted((str(r.doc_id), r.text or "") for r in run(spark, TEXTS, k)[1].collect()) for k in ("k", "k", "other"))
    assert first == again != other


def test_many_entities_stay_distinct(spark):
    rows = [(i, f"seen from 10.0.{i // 250}.{i % 250 + 1} by Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)}x") for i in range(600)]
    out = [r.text for r in run(spark, rows)[1].collect()]
    ips, names = {t.split()[2] for t in out}, {t.split()[-1].lower() for t in out}
    assert len(ips) == 600 and not ips & {t.split()[2] for _, t in rows}
    assert len(names) == 600


def test_empty(spark):
    assert run(spark, TEXTS)[1].limit(0).count() == 0
    assert run(spark, [])[1].count() == 0


def test_gender_is_that_of_the_title_and_names_agree_without_one(spark):
    rows = [
        (1, "So Mr. Kim and Mrs. Kim met Dr. Kim today"), (2, "Here is Frau Berg. Later Berg left, and Bergmann stayed with Dr. Berg."), (3, "Prof. Olsen spoke; Olsen sat"),
        (4, "Madame Kim wrote"), (5, "Kim and Berg stand here without title"), (6, "Then Herr O'Neil-Smith, called O'Neil-Smith"),
    ]
    by = {r.doc_id: r for r in run(spark, rows)[1].collect()}
    m = re.fullmatch(r"So Mr\. (\w+) and Mrs\. (\w+) met Dr\. (\w+) today", by[1].text)
    assert m[1] != m[2] and m[3] == m[1] and m[1].endswith("no") and m[2].endswith("na")
    assert by[4].text == f"Madame {m[2]} wrote"
    m = re.fullmatch(r"Here is Frau (\w+)\. Later (\w+) left, and Bergmann stayed with Dr\. (\w+)\.", by[2].text)
    assert m[1] == m[2] == m[3] != "Berg" and m[1].endswith("na") and by[2].n_entities == 3
    m = re.fullmatch(r"Prof\. (\w+) spoke; (\w+) sat", by[3].text)
    assert m[1] == m[2] != "Olsen" and m[1].endswith("ne")
    assert by[5].text == rows[4][1]
    m = re.fullmatch(r"Then Herr (\S+), called (\S+)", by[6].text)
    assert m[1] == m[2] and "Neil" not in by[6].text


def search(text, tried):
    out, at = [], 0
    while at < len(text):
        for kind, p in tried.items():
            m = p.match(text, at)
            if m and m.end() > at:
                out.append((at, m.end(), kind))
                at = m.end()
                break
        else:
            at += 1
    return out


def plain_mentions(text):
    """(start, end, kind) of the entities of a text, kind by kind at each place, then of the names found by a title."""
    tried = {k: regex.compile(p) for k, p in PATTERNS.items()}
    found = search(text, tried)
    names = {text[a:b] for a, b, kind in found if kind.startswith("name")}
    if not names:
        return found
    return search(text, tried | {"name_n again": regex.compile(rf"(?<![\p{{L}}'-])(?:{'|'.join(sorted(names))})(?![\p{{L}}'-])")})


def test_equals_a_search_row_by_row(spark):
    r = random.Random(11)
    names = ["Kim", "Berg", "Olsen", "Иванов"]
    made = [
        lambda: f"{r.choice('abc')}.{r.choice('xyz')}@{r.choice(['corp', 'mail'])}.example", lambda: f"10.{r.randrange(3)}.0.{r.randrange(9)}", lambda: f"{r.randrange(100, 103)}-45-6789", lambda: f"(555) 123-{r.randrange(4567, 4570)}",
        lambda: f"{r.choice(['Mr.', 'Mrs.', 'Frau', 'Dr.'])} {r.choice(names)}", lambda: f'token: "{r.choice("pq")}Zr8-Lm2_xx"', lambda: "DE89 3704 0044 0532 0130 00", lambda: r.choice(["4539 1488 0343 6467", "4539148803436467"]), lambda: "v1.2.3 and 2024-01-02",
    ]
    rows = [(i, " ".join(r.choice(made)() if r.random() < 0.3 else r.choice(["the", "and", "Word", "x9", "\n"]) for _ in range(r.randrange(1, 60)))) for i in range(150)]
    out = {x.doc_id: x for x in run(spark, rows)[1].collect()}
    seen = {}
    for i, text in rows:
        mentions = plain_mentions(text)
        assert out[i].n_entities == len(mentions)
        parts, at = [], 0
        for start, end, kind in mentions:
            parts.append(re.escape(text[at:start]) + ("(\\d+\\.\\d+\\.\\d+\\.\\d+)" if kind == "ip" else "(\\w+)" if kind.startswith("name") else f"(.{{{end - start}}})"))
            at = end
        m = re.fullmatch("".join(parts) + re.escape(text[at:]), out[i].text, re.DOTALL)
        assert m, (text, out[i].text)
        gender = {}
        for start, end, kind in mentions:
            if kind in ("name_m", "name_f"):
                gender.setdefault(text[start:end], []).append(kind)
        for (start, end, kind), new in zip(mentions, m.groups()):
            old = text[start:end]
            if kind.startswith("name_n"):
                kind = gender.get(old, ["name_n"])[0]
            norm = re.sub(r"\D", "", old) if kind in ("phone", "card", "ssn") else old
            new_norm = re.sub(r"\D", "", new) if kind in ("phone", "card", "ssn") else new
            assert new != old and seen.setdefault((kind, norm), new_norm) == new_norm
    assert len(seen) == len({(k, v) for (k, _), v in seen.items()}) and len(seen) > 25
    assert not {(k, v) for (k, _), v in seen.items()} & seen.keys()


def test_a_full_format_has_room_for_all(spark):
    """Every address of one letter at one letter is an entity: each still gets a surrogate of its own that is none of them."""
    rows = [(i, f"mail {chr(97 + i // 26)}@{chr(97 + i % 26)}.co now") for i in range(676)]
    new = [r.text.split()[1] for r in run(spark, rows)[1].collect()]
    assert len(set(new)) == 676 and not set(new) & {t.split()[1] for _, t in rows} and all(re.fullmatch(r"[a-z]+@[a-z]\.co", x) for x in new)


def surrogates(spark, kind, norms, key="k", tweak=0):
    from pyspark.sql import functions as F

    from attestor.llm.pii import surrogate

    df = spark.createDataFrame([(n,) for n in norms], "norm string").repartition(4)
    return {r.norm: r.new for r in df.select("norm", surrogate(F.lit(kind), F.col("norm"), key, F.lit(tweak)).alias("new")).collect()}


def test_permutations_of_whole_formats(spark):
    """Over all texts of a format the surrogates are all texts of that format."""
    digits = [f"{i:03d}" for i in range(1000)]
    assert set(surrogates(spark, "secret", digits).values()) == set(digits)
    assert surrogates(spark, "secret", digits) != surrogates(spark, "secret", digits, tweak=1)
    names = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "xyz"]
    new = surrogates(spark, "name_f", names)
    assert len(set(new.values())) == len(names) and all(re.fullmatch("[^aeiou][aeiou][^aeiou]na", x) for x in new.values())
    ips = [f"{a}.{b}.0.1" for a in range(40) for b in range(40)]
    new = set(surrogates(spark, "ip", ips).values())
    assert len(new) == 1600 and all(all(0 <= int(o) < 256 for o in x.split(".")) for x in new)


def test_check_digits_and_scripts(spark):
    def luhn(x: str) -> bool:
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(x))) % 10 == 0

    def mod97(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    cards = [f"4539148803{i:06d}" for i in range(3000)]
    new = surrogates(spark, "card", cards)
    assert len(set(new.values())) == 3000 and all(luhn(a) == luhn(b) and b[0] == "4" and len(b) == 16 for a, b in new.items())
    new = surrogates(spark, "iban", ["DE89370400440532013000", "GB29NWBK60161331926819", "DE88370400440532013000"])
    for a, b in new.items():
        assert a != b and a[:2] == b[:2] and (mod97(a) == 1) == (mod97(b) == 1) and [c.isdigit() for c in a] == [c.isdigit() for c in b]
    new = surrogates(spark, "email", ["用户@例子公司.com", "élan@ñandú.es", "ιαν@ελ.gr", "имя@почта.рф"])
    assert all(re.fullmatch("[\u4e00-\u9fa5]{2}@[\u4e00-\u9fa5]{4}\\.com", b) and a != b for a, b in new.items() if a.endswith("com"))
    assert all(re.fullmatch("[а-я]{3}@[а-я]{5}\\.рф", b) and a != b for a, b in new.items() if a.endswith("рф"))
    assert all(len(a) == len(b) and a != b for a, b in new.items())


def test_many_names_take_no_rounds(spark):
    """Far more names of one kind than five syllables could tell apart, by formula."""
    from pyspark.sql import functions as F

    from attestor.llm.pii import surrogate

    names = spark.range(0, 200_000, 1, 8).select(F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 26), 5, "0"), "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz").alias("norm"))
    new = names.select(surrogate(F.lit("name_m"), F.col("norm"), "k", F.lit(0)).alias("new"))
    assert new.distinct().count() == 200_000
