"""Personal data by boosted candidates, with DataFrame expressions only.

The base kinds (email, ip, card, phone) are found by their patterns and checks. High-recall generators propose more
spans: spelled-out emails, national phone numbers, social-security-like and bank-account-like numbers, and labelled
secrets. Each candidate gets format and context features; boosted trees score it; a threshold calibrated per kind on
held-out cases (precision of at least PRECISION) selects. Trees and thresholds are fitted on generated, labelled
sentences with the very expressions that score the corpus, and become one SQL expression; no Python runs on the data.

Positions come from splitting the text at the pattern: the lengths of the pieces and of the matches add up to offsets in
code points. Patterns are linear: possessive repeats, entered only where a run of their characters begins or where the
last match ended, so that very long runs cost no more than their length.

Defined cases: a null or empty text has no spans; repeated rows are treated alike; overlapping spans of several kinds
are all reported, and merged when a text is redacted; an empty table gives no rows; other columns, whatever their names, are kept or
ignored.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: Generators: pattern, and what a text must contain for it to be worth a look.
GENERATORS = {
    "email_spelled": (
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]{1,63}+)++",
        lambda t: F.contains(t, F.lit("dot")) | F.contains(t, F.lit("DOT")) | F.contains(t, F.lit("Dot")),
    ),
    "phone_local": (r"(?<![0-9+.()-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])(?![.-][0-9])", None),
    "ssn": (r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])", None),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", None),
    "secret": (
        r"(?i)(?<![A-Za-z])(?:api[_ -]?key|access[_ -]?key|secret|token|password|passwd)\x20{0,3}+[=:]\x20{0,3}+[\"']?[A-Za-z0-9_./+-]{6,}+[\"']?",
        lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")),
    ),
}
KINDS = [*BASE, *GENERATORS]
PRECISION, CONTEXT, ROUNDS, RATE, TRAIN_CASES = 0.95, 32, 40, 0.3, 3200
_SPANS = "array<struct<kind: string, start: int, end: int>>"
_FOUND = "array<struct<value: string, start: int, end: int>>"
_INTS = "array<int>"


def exclusive_sums(a: Column, block: int = 256) -> Column:
    """Sums of what stands before each element of an int array, in blocks, so that long arrays stay cheap."""

    def inside(b: Column) -> Column:
        zero = F.struct(F.array().cast(_INTS).alias("s"), F.lit(0).alias("t"))
        return F.aggregate(b, zero, lambda acc, x: F.struct(F.concat(acc["s"], F.array(acc["t"])).alias("s"), (acc["t"] + x).alias("t")))

    starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
    blocks = F.transform(starts, lambda k: inside(F.slice(a, k * block + 1, F.lit(block))))
    zero = F.struct(F.array().cast(_INTS).alias("s"), F.lit(0).alias("t"))
    done = F.aggregate(blocks, zero, lambda acc, r: F.struct(F.concat(acc["s"], F.transform(r["s"], lambda v: v + acc["t"])).alias("s"), (acc["t"] + r["t"]).alias("t")))
    return F.when(F.size(a) > 0, done["s"]).otherwise(F.array().cast(_INTS))


def _spans(pieces: Column, found: Column) -> Column:
    """Matches with their places. pieces: the text split at the matches, one more than those."""
    # zip_with pads with null; the last piece has no match after it.
    steps = F.zip_with(pieces, found, lambda p, m: (F.coalesce(F.char_length(p), F.lit(0)) + F.coalesce(F.char_length(m), F.lit(0))).cast("int"))
    before = exclusive_sums(steps)
    at = F.zip_with(before, F.transform(pieces, lambda p: F.char_length(p)), lambda b, n: b + n)
    got = F.zip_with(found, F.slice(at, F.lit(1), F.size(found)), lambda m, s: F.struct(m.alias("value"), s.cast("int").alias("start"), (s + F.char_length(m)).cast("int").alias("end")))
    return F.when(F.size(found) > 0, got).otherwise(F.array().cast(_FOUND))


def _located(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]], prefix: str) -> DataFrame:
    """Adds, for each pattern, a column of its leftmost non-overlapping matches with their places."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    found = {f"{prefix}m_{k}": F.when(F.lit(True) if c is None else c, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for k, (p, c) in patterns.items()}
    df = df.withColumns(found)
    df = df.withColumns({f"{prefix}p_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, F.split(t, p, -1)).otherwise(none) for k, (p, _) in patterns.items()})
    df = df.withColumns({f"{prefix}s_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, _spans(F.col(f"{prefix}p_{k}"), F.col(f"{prefix}m_{k}"))).otherwise(F.array().cast(_FOUND)) for k in patterns})
    return df.drop(*(f"{prefix}{x}_{k}" for x in "mp" for k in patterns))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits, a few dozen at most, passes the Luhn check."""
    n = F.char_length(d)

    def share(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 1, x * 2).otherwise(x)
        return F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + share(i)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(x, F.lit("0")), 1, 3)).cast("int") <= 255))
    if kind == "card":
        d = F.translate(v, " -", "")
        return F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    return F.lit(True)


# Format and context features of a candidate; every one is a number.
_WORDS = {
    "phone": "call phone tel telephone mobile cell fax dial ring whatsapp reach",
    "identity": "ssn social security passport licence license identity taxpayer",
    "bank": "iban account bank transfer wire deposit payment",
    "mail": "mail email write contact address reach send",
    "other": "version order invoice isbn part serial model section figure table page total lot room release build sku case docket claim ticket ref reference batch chapter catalogue",
}
_TLDS = "com org net edu gov io co info eu uk de fr es it nl ch at be us ca au jp"
FEATURES = [f"is_{k}" for k in GENERATORS] + [f"near_{w}" for w in _WORDS] + ["digits", "letters", "mixed", "length", "zeros", "same", "bracket", "glued", "iban_shape", "tld", "pass_key", "upper", "word_like"]


def _features(kind: str, v: Column, before: Column, after: Column) -> list[Column]:
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    near = [flag(F.rlike(before, F.lit(rf"(?i)\b(?:{'|'.join(ws.split())})\b"))) for ws in _WORDS.values()]
    d = _digits(v)
    body = F.regexp_replace(v, r"(?i)^.*?[=:]\s*", "") if kind == "secret" else v
    letters = F.char_length(F.regexp_replace(body, "[^A-Za-z]", ""))
    return [
        *(F.lit(1.0 if k == kind else 0.0) for k in GENERATORS),
        *near,
        F.char_length(d).cast("double"),
        letters.cast("double"),
        flag(F.rlike(body, F.lit("[0-9]")) & F.rlike(body, F.lit("[A-Za-z]"))),
        F.char_length(body).cast("double"),
        flag(F.rlike(v, F.lit(r"(?<![0-9])(?:000|666|9[0-9]{2})-|-00-|-0000"))),
        flag(F.rlike(d, F.lit(r"^(.)\1*$"))),
        flag(F.rlike(v, F.lit(r"[\[(]"))),
        flag(F.rlike(after, F.lit(r"^[A-Za-z0-9_]")) | F.rlike(before, F.lit(r"[A-Za-z0-9_]$"))),
        flag(F.rlike(v, F.lit(r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)[0-9]{2}"))),
        flag(F.rlike(v, F.lit(rf"(?i)[^a-z](?:{'|'.join(_TLDS.split())})$"))),
        flag(F.rlike(v, F.lit("(?i)^pass"))),
        F.char_length(F.regexp_replace(body, "[^A-Z]", "")).cast("double"),
        flag(F.rlike(body, F.lit("^[\"']?(?:[a-z]+|[A-Z][a-z]+|[A-Z]+)[\"']?$"))),
    ]


@dataclass
class Trees:
    """Depth-two trees: (feature, cut, left (feature, cut, a, b), right (feature, cut, a, b)); and a threshold by kind."""

    base: float
    trees: list[tuple]
    thresholds: dict[str, float]

    def score(self, x: list[float]) -> float:
        total = self.base
        for f, c, left, right in self.trees:
            g, e, a, b = left if x[f] <= c else right
            total += a if x[g] <= e else b
        return total

    def column(self, x: Column) -> Column:
        """The score of the features ``x``: one pass over the trees as an array, so that the plan stays small."""
        side = lambda t: F.struct(*(F.lit(v).alias(n) for n, v in zip("fcab", (t[0], float(t[1]), float(t[2]), float(t[3])))))
        trees = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(float(c)).alias("c"), side(left).alias("l"), side(right).alias("r")) for f, c, left, right in self.trees))
        leaf = lambda t: F.when(F.get(x, t["f"]) <= t["c"], t["a"]).otherwise(t["b"])
        return F.aggregate(trees, F.lit(float(self.base)), lambda acc, t: acc + F.when(F.get(x, t["f"]) <= t["c"], leaf(t["l"])).otherwise(leaf(t["r"])))


def _best_cut(rows: list[int], xs: list[list[float]], grad: list[float], hess: list[float]) -> tuple[float, int, float]:
    """(gain, feature, cut) of the best split of the rows."""
    g_all, h_all = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (-1.0, 0, math.inf)
    for f in range(len(FEATURES)):
        bins: dict[float, list[float]] = {}
        for i in rows:
            b = bins.setdefault(xs[i][f], [0.0, 0.0])
            b[0] += grad[i]
            b[1] += hess[i]
        g = h = 0.0
        for v in sorted(bins)[:-1]:
            g, h = g + bins[v][0], h + bins[v][1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, v)
    return best


def boost(xs: list[list[float]], ys: list[int], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Gradient boosting of log loss with trees of depth two and Newton leaves."""
    p = min(max(sum(ys) / len(ys), 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    score = [base] * len(xs)
    trees = []
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        grad, hess = [y - q for y, q in zip(ys, prob)], [q * (1 - q) for q in prob]
        leaf = lambda rows: rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1)  # noqa: B023, E731
        _, f, c = _best_cut(range(len(xs)), xs, grad, hess)
        sides = []
        for rows in ([i for i, x in enumerate(xs) if x[f] <= c], [i for i, x in enumerate(xs) if x[f] > c]):
            _, g, e = _best_cut(rows, xs, grad, hess)
            low, high = [i for i in rows if xs[i][g] <= e], [i for i in rows if xs[i][g] > e]
            a, b = leaf(low), leaf(high)
            for i in low:
                score[i] += a
            for i in high:
                score[i] += b
            sides.append((g, e, a, b))
        trees.append((f, c, *sides))
    return Trees(base, trees, {})


_FILLER = "the a of and to in was is for on with by from that this it we they she he had not but all were their one has been our more will no which there new then some two made can only other time very first any now man your may most such like over did me even well also back after use how work".split()
_NAMES = "john mary peter anna smith jones lee maria paul kim omar nina david garcia muller ivan lucia tom".split()
_SITES = "gmail yahoo example mail school company office web shop university team lab".split()


def training_cases(n: int = TRAIN_CASES, seed: int = 5) -> list[tuple[str, int]]:
    """Generated sentences with one candidate each and whether it is personal data. What decides is what decides in real
    text: the shape where it is telling (a top-level domain, a key and a mixed value, numbers that are never given out), the
    words before where it is not."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: r.choice(_FILLER) if r.random() < 0.7 else "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    any_of = lambda *a: r.choice(a)
    lead = {k: v.split() for k, v in _WORDS.items()}
    cue_of = lambda kind: any_of(*lead[kind]) + any_of("", "", ":", " is", " no.", " number", " number is", " me at", " of")
    out = []
    for _ in range(n):
        kind, good = r.choice(list(GENERATORS)), r.random() < 0.5
        before = " ".join(word() for _ in range(r.randint(0, 5)))
        cue = word()
        if kind == "email_spelled":
            user = any_of(f"{any_of(*_NAMES)}.{any_of(*_NAMES)}", f"{any_of(*_NAMES)}{num(2)}", any_of(*_NAMES), word() + "_" + word())
            wrapped = r.random() < 0.5
            at, dot = (any_of(" [at] ", "[at]", " (at) ", "(at)"), any_of(" [dot] ", "[dot]", " (dot) ", "(dot)")) if wrapped else (" at ", " dot ")
            good = good or wrapped
            # Plain words between which "at" and "dot" stand are no address unless they end as one.
            value = f"{user}{at}{any_of(*_SITES, word())}{dot}{any_of(*_TLDS.split()[:16]) if good else any_of(*_FILLER, 'line', 'matrix', 'product')}"
            cue = any_of(cue_of("mail"), word()) if good else word()
        elif kind == "phone_local":
            value = any_of(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
            cue = cue_of("phone") if good else any_of(cue_of("other"), word())
            if "(" in value and r.random() < 0.7 and not any(w in cue for w in lead["other"]):
                good = True
        elif kind == "ssn":
            area = any_of(r.randint(1, 665), r.randint(667, 899))
            value = f"{area:03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            if good:
                cue = any_of(cue_of("identity"), word())
            elif r.random() < 0.5:
                cue = cue_of("other")
            else:
                value = any_of(f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"666-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"{num(3)}-{num(2)}-0000")
                cue = any_of(cue_of("identity"), cue_of("other"), word())
        elif kind == "iban":
            body = "".join(num(4) if r.random() < 0.8 else any_of("ABNA", "BARC", "DEUT", "INGB", "NWBK") for _ in range(r.randint(3, 5)))
            body = " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if r.random() < 0.5 else body
            gap = " " if " " in body else ""
            value = any_of("DE", "FR", "GB", "NL", "ES", "IT", "CH", "BE", "AT", "PL") + num(2) + gap + body if good else any_of("QX", "ZZ", "AB", "XK", "ID", "NR") + num(2) + gap + body
            cue = any_of(cue_of("bank"), word()) if good else any_of(cue_of("other"), word())
        else:
            mixed = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(r.randint(12, 40)))
            short = any_of(any_of(*_NAMES, *_SITES, "hunter", "summer", "dragon", "secret") + num(any_of(1, 2, 4)), any_of(*_NAMES).title() + num(4), mixed[:8] + "7x")
            plain = any_of(any_of("required", "optional", "incorrect", "expired", "missing", "string", "default", "disabled", "forgotten", "nothing"), any_of("Required", "Optional"), word() + word() + word(), num(6))
            value = any_of("token", "api_key", "secret", "access key", "API-KEY") if r.random() < 0.6 else any_of("password", "passwd", "Password")
            body = (short if value.lower().startswith("pass") or r.random() < 0.2 else mixed) if good else plain
            quote = any_of("", "", '"', "'")
            good = good and any(c.isdigit() for c in body) and any(c.isalpha() for c in body) and len(body) >= 6
            value = f"{value}{any_of(' = ', ': ', '=')}{quote}{body}{quote}"
        glued = "" if good or r.random() < 0.9 else "x"
        out.append((f"{before} {cue} {value}{glued} {word()}{any_of('.', ',', '')}".strip(), int(good)))
    return out


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Adds g_<kind>: candidates as (start, end, features)."""
    t = F.col(text)
    digits = F.rlike(t, F.lit("[0-9]{3}"))
    df = _located(df, text, {k: (p, digits if c is None else c(t)) for k, (p, c) in GENERATORS.items()}, "_g")

    def described(kind: str) -> Column:
        def one(m: Column) -> Column:
            before = F.substring(t, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
            after = F.substring(t, m["end"] + 1, F.lit(8))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.array(*_features(kind, m["value"], before, after)).alias("x"))

        return F.transform(f"_gs_{kind}", one)

    empty = "array<struct<start: int, end: int, x: array<double>>>"
    df = df.withColumns({f"g_{k}": F.when(F.size(f"_gs_{k}") > 0, described(k)).otherwise(F.array().cast(empty)) for k in GENERATORS})
    return df.drop(*(f"_gs_{k}" for k in GENERATORS))


@lru_cache(maxsize=4)
def fitted(spark: SparkSession, n: int = TRAIN_CASES) -> Trees:
    """Trees and thresholds, fitted on generated cases: three quarters train, the rest calibrates each kind."""
    cases = [{"id": i, "t": t, "y": y} for i, (t, y) in enumerate(training_cases(n))]
    rows = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(cases)), "array<struct<id: int, t: string, y: int>>")))

    got = _candidates(rows, "t").select("id", "y", F.concat(*(F.transform(f"g_{k}", _named(k)) for k in GENERATORS)).alias("c"))
    data = [(r["id"], r["y"], r["c"][0]["kind"], list(r["c"][0]["x"])) for r in got.where(F.size("c") == 1).collect()]
    train = [d for d in data if d[0] % 4]
    model = boost([d[3] for d in train], [d[1] for d in train])
    for kind in GENERATORS:
        scored = sorted(((model.score(d[3]), d[1]) for d in data if d[0] % 4 == 0 and d[2] == kind), reverse=True)
        best, good = math.inf, 0
        for i, (s, y) in enumerate(scored):
            good += y
            if good >= PRECISION * (i + 1) and (i + 1 == len(scored) or scored[i + 1][0] < s):
                best = s
        model.thresholds[kind] = best if best < math.inf else 1e9
    return model


def with_spans(docs: DataFrame, text: str = "text", model: Trees | None = None) -> DataFrame:
    """Adds _base and _spans, arrays of (kind, start, end) in code points, ordered by kind and start."""
    model = model or fitted(docs.sparkSession)
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col("_t")
    some = {"email": F.contains(t, F.lit("@")), "ip": F.contains(t, F.lit(".")) & F.rlike(t, F.lit("[0-9]")), "card": F.rlike(t, F.lit("[0-9]")), "phone": F.contains(t, F.lit("+"))}
    df = _located(df, "_t", {k: (p, some[k]) for k, p in BASE.items()}, "_b")
    df = _candidates(df, "_t")

    def chosen(kind: str, column: str, keep: Callable[[Column], Column]) -> Column:
        named = F.transform(F.filter(column, lambda m: keep(m)), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(F.size(column) > 0, named).otherwise(F.array().cast(_SPANS))

    kept = {f"_k_{k}": chosen(k, f"_bs_{k}", lambda m, k=k: _valid(k, m["value"])) for k in BASE}
    # The candidates of all kinds are scored by one expression.
    every = F.concat(*(F.transform(f"g_{k}", _named(k)) for k in GENERATORS))
    least = F.create_map(*(F.lit(x) for k in GENERATORS for x in (k, float(model.thresholds[k]))))
    df = df.withColumns({**kept, "_every": every})
    scored = F.transform(F.filter("_every", lambda m: model.column(m["x"]) >= least[m["kind"]]), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    df = df.withColumn("_extra", F.when(F.size("_every") > 0, scored).otherwise(F.array().cast(_SPANS)))
    base = F.concat(*(F.col(f"_k_{k}") for k in BASE))
    df = df.withColumns({"_base": base, "_spans": F.concat(base, F.col("_extra"))})
    return df.drop("_every", "_extra", *(f"_bs_{k}" for k in BASE), *(f"g_{k}" for k in GENERATORS), *(f"_k_{k}" for k in BASE))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["x"].alias("x"))


def redacted(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one, under the
    kind that starts first. n_chars, where there is such a column, follows the text."""
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    packed = docs.select(F.struct(*(F.col(q) for q in quoted.values())).alias("_row"), F.col("text").alias("_text"))  # no name of theirs meets ours
    df = with_spans(packed, "_text", model)
    t = F.col("_t")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        hidden = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(hidden).alias("out"))

    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"), s["end"].alias("end"))))
    df = df.withColumn("_done", F.when(F.size("_spans") > 0, F.aggregate(ordered, zero, step)))
    df = df.withColumn("_clean", F.when(F.size("_spans") > 0, F.concat(F.col("_done")["out"], F.substring(t, F.col("_done")["at"] + 1, F.char_length(t)))).otherwise(F.col("_text")))
    out = {c: F.col(f"_row.{q}") for c, q in quoted.items()} | {"text": F.col("_clean")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("_spans") > 0, F.char_length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return df.select(*(x.alias(c) for c, x in out.items()))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))
