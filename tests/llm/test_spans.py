import hashlib
import random
import re

from arbolex.llm import decontamination, pii

from .fixtures import corpus, frame, prose

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "1", "0", "255", "256", ".", ".", "@", "@", "+", "-", " ", "(", ")", "_", "é", "😀", "\n", "4111111111111111", "x.y@z.com", "+1 (743) 555-3824", "1.2.3.4", "378282246310005"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += [None, "", "a@b.c@d.e.f", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "+12", "+1 2345678901", "é 4111 1111 1111 1111-", "0255.01.1.1", "00001.2.3.4", "9" * 5000, "1 " * 3000, "a" * 20000, "+1" + " " * 4000 + "2", "a.b@c.d " * 700, "😀 " * 300 + "q@w.er"]
    return out


def test_pii_base_against_brute_force(spark):
    ts = texts()
    df = pii.with_spans(frame(spark, ts).select("doc_id", "text"))
    got = {r["doc_id"]: r for r in df.select("doc_id", pii._joined("_base").alias("b"), pii._joined("_spans").alias("s")).collect()}
    for k, t in enumerate(ts):
        want = plain_spans(t)
        assert got[k]["b"] == ",".join(want), (k, t)
        assert got[k]["s"].startswith(got[k]["b"])


def test_pii_digest(spark, tmp_path):
    ts = texts()[:50]
    frame(spark, ts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op5_boosted_candidates(spark, str(tmp_path)).collect():
        want = plain_spans(ts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]


def test_pii_candidates_and_accuracy(spark):
    cases = pii.training_cases(600, seed=99)
    df = pii.with_spans(frame(spark, [t for t, _ in cases]).select("doc_id", "text"))
    got = {r["doc_id"]: [s["kind"] for s in r["_spans"] if s["kind"] in pii.GENERATORS] for r in df.select("doc_id", "_spans").collect()}
    hit = [bool(got[k]) for k in range(len(cases))]
    precision = sum(h and y for h, (_, y) in zip(hit, cases)) / max(1, sum(hit))
    recall = sum(h and y for h, (_, y) in zip(hit, cases)) / sum(y for _, y in cases)
    assert precision > 0.9 and recall > 0.7, (precision, recall)
    model = pii.fitted(spark)
    assert pii.fitted(spark) is model and all(t < 1e9 for t in model.thresholds.values())


#: Lines written by hand, apart from the generator: what is personal data in them, and lines that hold none.
LINES = {
    "email_spelled": ["write to john.smith at gmail dot com please", "my address is jane_doe [at] uni-mail [dot] ac [dot] uk", "contact: bob(at)acme(dot)org", "reach sales at example dot com or call", "it is p.lang at web dot de, thanks"],
    "phone_local": ["call me at 555-867-5309 tonight", "Tel. (212) 555-0147", "fax: 303.555.0182", "our office (415) 555-2671 is open", "mobile 646-555-0119, home later"],
    "ssn": ["her social security number is 512-44-9021", "SSN: 219-09-9999", "the form says 457-55-5462 under ssn", "passport and 123-45-6789 were found"],
    "iban": ["transfer to DE89 3704 0044 0532 0130 00 today", "IBAN GB29NWBK60161331926819", "my account FR1420041010050500013M02606 in Paris", "pay NL91ABNA0417164300 now"],
    "secret": ["password: hunter2", "api_key = 9f8a7b6c5d4e3f2a1b0c", "token: ghp_16C7e42F292c6912E7710c838347Ae178B4a", "the passwd=Winter2024 leaked", "secret: 'a1B2c3D4e5F6g7H8'"],
}
CLEAN = [
    "we met at noon dot com was young then", "look at this dot matrix", "she stood at the dot line", "part 555-123-4567 of the catalogue", "order no. 212-555-0147 has shipped", "case 512-44-9021 was filed",
    "ticket 219-09-9999 is closed", "invoice 000-12-3456 is due", "ref 666-45-6789", "serial ZZ12 3456 7890 1234 5678", "model QX9912345678901234", "password: required", "token: optional", "the secret: nothing works", "version 303.555.0182 of the build",
    "password: incorrect", "chapter 3, section 4-12", "room 12-34, page 567", "the score was 100-99-98", "see figure 123-456-7890", "access key: missing",
]


def test_pii_on_lines_written_by_hand(spark):
    lines = [(k, t) for k, ts in LINES.items() for t in ts] + [(None, t) for t in CLEAN]
    df = pii.with_spans(frame(spark, [t for _, t in lines]).select("doc_id", "text"))
    got = {r["doc_id"]: {s["kind"] for s in r["_spans"] if s["kind"] in pii.GENERATORS} for r in df.select("doc_id", "_spans").collect()}
    found = {k: sum(k in got[i] for i, (kind, _) in enumerate(lines) if kind == k) / len(ts) for k, ts in LINES.items()}
    wrong = [(lines[i][1], got[i]) for i in got if got[i] - {lines[i][0]}]
    assert all(x >= 0.75 for x in found.values()) and sum(found.values()) >= 4.5, found
    assert len(wrong) <= 2, wrong


def test_redaction(spark):
    ts = ["mail é a@b.com now", "1.2.3.4 and 4111 1111 1111 1111!", None, "clean", "x +1 (743) 555-3824"]
    docs = frame(spark, ts)
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert pii.redacted(docs).columns == docs.columns
    assert [rows[k]["text"] for k in range(5)] == ["mail é <EMAIL> now", "<IP> and <CARD>!", None, "clean", "x <PHONE>"]
    assert rows[0]["n_chars"] == len(rows[0]["text"])


def benchmark(spark, items):
    return spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")


ITEM = "If a train leaves the old station at 40 km per hour and Maria waits 15 minutes then how far does the train of Maria go before noon"


def test_decontamination(spark):
    rng = random.Random(2)
    clean = [prose(rng, 200) for _ in range(20)]
    changed = ITEM.replace("40", "75").replace("15", "33").replace("Maria", "Joanne")
    mixed_up = ITEM.replace("of Maria", "of Joanne").replace("40", "12")
    half = " ".join(ITEM.split()[:20])
    ts = [*clean, clean[0] + " " + ITEM + " " + clean[1], ITEM.upper(), clean[2] + ". " + changed + "\n" + clean[3], half, " ".join(ITEM.split()[:9]), None, "", ITEM.replace(" ", "!! "), "short question here now ok", mixed_up]
    items = [(1, ITEM), (2, "short question here now ok"), (3, None), (4, "tiny"), (5, ITEM.replace("40", "60")), (6, prose(random.Random(77), 50))]
    docs = frame(spark, ts)
    got = {r["doc_id"]: [(h["item_id"], h["changed_slots"]) for h in r["hits"]] for r in decontamination.with_hits(docs, benchmark(spark, items)).collect()}
    assert len(got) == len(ts)
    assert all(not got[k] for k in range(20))
    assert got[20] == [(1, 0)] and [i for i, _ in got[21]] in ([], [1]) and got[22] == [(1, 4)]
    assert got[23] == [(1, 0)] and got[24] == [] and got[25] == [] and got[26] == []
    assert [i for i, _ in got[27]] == [1] and got[28] == [(2, 0)]
    kept = {r["doc_id"] for r in decontamination.decontaminated(docs, benchmark(spark, items)).collect()}
    assert kept == {k for k in got if not got[k]}
    assert decontamination.decontaminated(docs, benchmark(spark, [(1, None)])).count() == len(ts)
    assert decontamination.with_hits(docs.where("doc_id < 0"), benchmark(spark, items)).count() == 0


def test_decontamination_of_items_rich_in_slots(spark):
    rng = random.Random(9)
    items = [(1, "Compute 17 + 25 - 8 + 4"), (2, "Compute 3 + 9 - 1 + 2"), (3, "Old Harbour Summer Music Festival Opening Night Grand Parade Of Lanterns"), (4, "12 7 3.5 88 41 6 19 23 5 77 1,024 2"), (5, "Anna Berlin Carl Dora Emil Frida")]
    around = lambda t: f"{prose(rng, 40)} and then {t} {prose(rng, 40)}"
    ts = [around(t) for _, t in items] + [around("Compute 5 + 25 - 8 + 4"), around("12 7 3.5 88 99 6 19 24 5 78 1,024 3"), prose(rng, 80)]
    ts.append(" ".join(f"the {w} is here." if k % 3 else f"we saw {w} there." for k, w in enumerate(items[2][1].split())) + " so " + items[2][1])
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.with_hits(frame(spark, ts), benchmark(spark, items)).collect()}
    assert [got[k] for k in range(9)] == [[1], [2], [3], [4], [5], [], [], [], [3]]


def test_decontamination_of_sums_and_short_items(spark):
    rng = random.Random(19)
    items = [(1, "What is 17 + 25?"), (2, "Solve 3 x + 5 = 20."), (3, "Compute 12 * 7 + 3 - 4 / 2 for x = 5."), (4, "3 + 4 = 7"), (5, "Who wrote it?"), (6, "???"), (7, "Nam\u00e9")]
    around = lambda t: f"{prose(rng, 40)}. {t} {prose(rng, 40)}"
    ts = [around(t) for _, t in items[:4]] + [around(t) for t in ("What is 31 + 4?", "Solve 8 x + 1 = 99.", "Compute 2 * 70 + 13 - 44 / 9 for x = 6.", "What is 31 - 4?", "Solve 8 y + 1 = 99.", "3 + 5 = 8", "who wrote it? ")]
    ts += [f"{prose(rng, 9)}\n  who WROTE it \n{prose(rng, 9)}", "who wrote it\nnow", "??? ?", "nam\u00e9", "it is nam\u00e9", "What is " + "9" * 4000 + " + 25?"]
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.with_hits(frame(spark, ts), benchmark(spark, items)).collect()}
    assert [got[k] for k in range(len(ts))] == [[1], [2], [3], [4], [1], [2], [3], [], [], [], [], [5], [5], [], [7], [], [1]]


def reparameterised(rng):
    """A question and the same one with other numbers and names."""
    people, places = ["Anna", "Omar", "Lucy", "Pavel", "Wei", "Ines"], ["Lyon", "Porto", "Graz", "Turku", "Leeds"]
    verbs, things = ["buys", "sells", "packs", "counts", "paints"], ["apples", "boxes", "stamps", "chairs", "lamps", "coins"]
    kind, v, t = rng.randrange(4), rng.sample(verbs, 2), rng.sample(things, 2)
    ops = [rng.choice("+-*/") for _ in range(rng.randint(2, 5))]

    def said():
        (a, b), p, (m, n, k) = rng.sample(people, 2), rng.choice(places), rng.sample(range(2, 400), 3)
        if kind == 0:
            return f"In the town of {p} the shop of {a} {v[0]} {m} {t[0]} in the morning and {n} {t[1]} at night so how many does {a} have after {k} days"
        if kind == 1:
            return f"Yesterday {a} {v[0]} {m} {t[0]} while {b} {v[1]} {n} {t[1]}, and later {a} gives {k} of them to {b}; how many are left with {b}?"
        if kind == 2:
            return "Evaluate " + " ".join(f"{rng.randint(2, 99)} {o}" for o in ops) + f" {rng.randint(2, 99)} = ?"
        return f"Find the value of x if {m} x {ops[0]} {n} = {k} * ( x {ops[1]} 2 )"

    return said(), said()


def test_recall_of_reparameterised_questions(spark):
    """Nine in ten are found at least, in running text, and no clean text is."""
    rng = random.Random(41)
    pairs = [reparameterised(rng) for _ in range(120)]
    ts = [f"{prose(rng, 60)}. {other} {prose(rng, 60)}" for _, other in pairs] + [prose(rng, 200) for _ in range(60)]
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.with_hits(frame(spark, ts), benchmark(spark, [(k, p[0]) for k, p in enumerate(pairs)])).collect()}
    found = sum(bool(got[k]) for k in range(120))
    assert found >= 0.9 * 120, found
    assert not any(got[k] for k in range(120, 180))


NUMBERED = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+(?:(?<=[0-9])[.,](?=[0-9])[A-Za-z0-9\u0080-\U0010ffff]+)*")


def plain_template(text):
    """(placeholder or word, value) of each token of a lower-case text, where there are no names."""
    out = []
    for m in NUMBERED.finditer(text):
        v = m[0]
        kind = "#" if re.search("[0-9]", v) else "unit" if out and out[-1][0] == "#" and v in decontamination.UNITS.split() else v
        out.append((kind, v))
    return out


def plain_hits(doc, item):
    """By definition: windows of the item of which half are words, found along diagonals whose slots map one to one."""
    a, b = plain_template(item), plain_template(doc)
    n = min(8, len(a))
    for plain in (False, True):
        x, y = ([(v, v) if plain else (k, v) for k, v in t] for t in (a, b))
        starts = [i for i in range(len(x) - n + 1) if 2 * sum(k == v for k, v in x[i : i + n]) >= n]
        covered = set()
        for d in range(-len(x), len(y)):
            mine = [i for i in starts if 0 <= i + d <= len(y) - n and [k for k, _ in x[i : i + n]] == [k for k, _ in y[i + d : i + d + n]]]
            slots = [j for j in sorted({i + o for i in mine for o in range(n)}) if x[j][0] != x[j][1]]
            forth, back = {}, {}
            bad = sum(forth.setdefault(x[j][1], y[j + d][1]) != y[j + d][1] or back.setdefault(y[j + d][1], x[j][1]) != x[j][1] for j in slots)
            if bad <= 0.2 * len(slots):
                covered.update(mine)
        if starts and len(covered) >= 0.5 * len(starts):
            return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(23)
    pool = [*"the red cat sees two old km kg 3 14 7,5 dogs in a big town by noon 40 99".split()]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, say(rng.randint(6, 24))) for k in range(25)]
    swap = lambda t: " ".join(str(rng.randint(1, 60)) if w[0].isdigit() and rng.random() < 0.5 else w for w in t.split())
    ts = [say(rng.randint(0, 30)) + " " + swap(items[rng.randrange(25)][1]) + " " + say(rng.randint(0, 30)) for _ in range(40)]
    ts += [" ".join(items[k][1].split()[: len(items[k][1].split()) // 2 + 2]) for k in range(25)] + [say(60) for _ in range(10)]
    got = {r["doc_id"]: bool(r["hits"]) for r in decontamination.with_hits(frame(spark, ts), benchmark(spark, items)).collect()}
    assert got == {k: any(plain_hits(t, i) for _, i in items) for k, t in enumerate(ts)}


def test_decontamination_blocks_agree(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(6, 40))) for k in range(40)] + [(100, "What is 17 + 25?"), (101, "Who wrote it?")]
    ts = [prose(rng, 30) + " " + items[k % 40][1] + " " + prose(rng, 20) for k in range(60)]
    ts += [None, "", ts[0], prose(rng, 10) + ". What is 3 + 4? " + prose(rng, 20), "so\nwho wrote it\nthen", prose(rng, 90), items[3][1] + " and " + items[30][1]]
    docs, bench = frame(spark, ts), benchmark(spark, items)
    one = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.with_hits(docs, bench).collect()}
    assert all(k % 40 in one[k] for k in range(60))
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (200,))
    many = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontamination.with_hits(docs, bench).collect()}
    assert many == one
    assert [many[k] for k in range(60, 67)] == [[], [], [0], [100], [101], [], [3, 30]]
    kept = sorted(r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect())
    assert kept == [60, 61, 65] and decontamination.decontaminated(docs, bench).columns == docs.columns
