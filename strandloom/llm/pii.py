"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds.

Everything over texts is DataFrame expressions; a document's row is never split or shuffled.

* Base detectors give spans of four kinds by pattern and check (see BASE).
* Generators propose further, overlapping spans with high recall (see GENERATORS): obfuscated
  addresses, spaced or bracketed IPs, card numbers inside longer runs, national phone numbers, secrets.
* Each candidate has binned features of format, check digits and context. Trees are boosted on
  labelled examples: by default ``examples``, sentences that hold one item each, true ones in the
  forms that the base patterns miss, and false ones that look alike (order numbers, dates, hashes).
* Half of the examples fit the trees; on the other half scores are calibrated by kind, and a
  candidate is selected where its calibrated share of true ones reaches ``precision``. Additions
  that overlap a base span are dropped; base spans always stay.

Patterns use possessive loops and look-behinds only where the matches stay the same; they keep long
runs linear and off the matcher's stack.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: kinds of spans that the model may add
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind -> (pattern, strings of which a text with a match must hold one, whether it must hold a digit)
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), False),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", (".",), True),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", (), True),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), True),
}
#: generator -> (kind it proposes, pattern, strings, digit)
GENERATORS = {
    "mail": ("email", rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)*+", ("@", "(at)", "[at]"), False),
    "quad": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}(?![0-9])", (".",), True),
    "groups": ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2,3}(?:[\x20.-]?[0-9]{1,3})?(?![0-9])", (), True),
    "solid": ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", (), True),
    "plus": ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{2,4}(?![0-9])", ("+",), True),
    "local": ("phone", r"(?<![0-9+])(?:00)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,7}){1,4}(?![0-9])", (), True),
    "opaque": ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,60}[0-9])[A-Za-z0-9+/_-]{20,}+", (), True),
}
#: last characters before a candidate, the first that fits counts
CONTEXTS = {
    1: r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|bearer|credential)\W{0,6}$", 2: r"(?i)(?:tel|phone|call|fax|mobile|whatsapp)[^\n]{0,12}$", 3: r"(?i)(?:card|visa|master|credit|account|payment)[^\n]{0,12}$",
    4: r"(?i)(?:mail|contact|write)[^\n]{0,12}$", 5: r"(?i)(?:\bip|host|server|address)[^\n]{0,12}$", 6: r"(?i)(?:\bid|hash|commit|sha\w*|order|version|isbn|sku|\bno|ref|date|section)\W{0,6}$",
}
#: feature -> number of bins
FEATURES = {"source": len(GENERATORS), "digits": 8, "check": 3, "plus": 2, "separators": 3, "context": 7, "glued": 2, "lead": 6, "mixed": 4, "size": 6}


def spans(text: Column, pattern: str, strings: tuple[str, ...], digit: Column | None) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches with code point offsets.

    Texts that hold none of ``strings``, or no ``digit``, have no match and are not scanned.
    """
    match = "array<struct<s:int,e:int,m:string>>"
    none = F.array().cast(match)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def place(found: Column, between: Column) -> Column:
        n = F.size(found)
        block = F.ceil(F.sqrt(n)).cast("int")

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(between[i])
            e = s + F.length(found[i])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), found[i].alias("m")))).alias("out"))

        def blocks(acc: Column, k: Column) -> Column:
            # appending copies what is there, so matches are gathered in blocks of about the root of their number
            mine = F.aggregate(F.sequence(k * block, F.least(n, (k + 1) * block) - 1), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(mine), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{match}>").alias("out"))
        parts = F.aggregate(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), start, blocks, lambda acc: acc["out"])
        return F.when(n > 0, F.flatten(parts)).otherwise(none)

    # a one-element transform binds both arrays once
    made = F.transform(F.array(F.struct(found.alias("f"), between.alias("b"))), lambda x: place(x["f"], x["b"]))[0]
    may = F.lit(True) if digit is None else digit
    if strings:
        may = may & reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in strings))
    return F.when(may, made).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the check digit of a digit string holds."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        size = F.length(digits(m))
        return F.when(F.length(m) < 12, False).when((size < 12) | (size > 19), False).otherwise(luhn(digits(m)))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: valid(kind, x["m"])


def _tagged(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def base_spans(text: Column, digit: Column) -> Column:
    """All base spans, by start and then kind: array<struct<s, k, e>>, k the kind's place in KINDS. ``digit``: the text holds one."""
    found = []
    for k, kind in enumerate(KINDS):
        pattern, strings, digits_only = BASE[kind]
        found.append(_tagged(F.filter(spans(text, pattern, strings, digit if digits_only else None), _check(kind)), k))
    return F.array_sort(F.concat(*found))


def _bin(x: Column, edges: tuple[int, ...]) -> Column:
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x <= edges[i], i).otherwise(out)
    return out


def candidates(text: Column, digit: Column) -> Column:
    """array<struct<s, k, e, features...>> of all generators."""
    return F.concat(*(F.transform(spans(text, pattern, strings, digit if digits_only else None), _describe(text, g, kind)) for g, (kind, pattern, strings, digits_only) in enumerate(GENERATORS.values())))


def _checked(kind: str, m: Column) -> Column:
    """1: the kind's own check holds, 2: it fails, 0: there is none."""
    if kind == "email":
        holds = m.rlike(r"(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}$")
    elif kind == "ip":
        holds = valid("ip", F.regexp_replace(m, r"[^0-9.]", ""))
    elif kind == "card":
        holds = valid("card", m)
    else:
        return F.lit(0)
    return F.when(holds, 1).otherwise(2)


def _describe(text: Column, g: int, kind: str):
    def describe(x: Column) -> Column:
        m, n = x["m"], F.length(digits(x["m"]))
        before = F.substring(text, F.greatest(F.lit(1), x["s"] - 23), F.least(x["s"], F.lit(24)))
        context = F.lit(0)
        for c in sorted(CONTEXTS, reverse=True):
            context = F.when(before.rlike(CONTEXTS[c]), c).otherwise(context)
        glued = before.rlike(r"[A-Za-z0-9_]$") | F.substring(text, x["e"] + 1, F.lit(1)).rlike("[A-Za-z_]")
        form = F.when(m.rlike(r"^[0-9\x20().+/-]+$"), 0).when(m.rlike("^[0-9a-fA-F]+$"), 1).when(m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"), 2).otherwise(3)
        return F.struct(
            x["s"].alias("s"), F.lit(ALL_KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(g).alias("source"), _bin(n, (0, 6, 8, 11, 15, 16, 19)).alias("digits"), _checked(kind, m).alias("check"),
            m.startswith("+").cast("int").alias("plus"), _bin(F.length(F.regexp_replace(m, "[^ ().@/-]", "")), (0, 2)).alias("separators"), context.alias("context"), glued.cast("int").alias("glued"),
            F.when(n == 0, 0).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(v) for v in ("0", 1, "1", 2, "2", 3, "9", 4))), F.substring(digits(m), 1, 1)), F.lit(5))).alias("lead"),
            form.alias("mixed"), _bin(F.length(m), (11, 19, 31, 39, 63)).alias("size"),
        )

    return describe


class Boosted:
    """Gradient-boosted trees of bounded depth for 0/1 labels, fitted on weighted feature vectors."""

    def __init__(self, trees: list, bias: float, rate: float):
        self.trees, self.bias, self.rate = trees, bias, rate

    @classmethod
    def fit(cls, cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
        """cells: (features, weight, weight of label 1)."""
        n, p = sum(c[1] for c in cells), sum(c[2] for c in cells)
        bias = math.log((p + 1) / (n - p + 1))
        model, f = cls([], bias, rate), [bias] * len(cells)
        for _ in range(rounds):
            q = [1 / (1 + math.exp(-v)) for v in f]
            grad = [c[2] - c[1] * x for c, x in zip(cells, q)]
            hess = [c[1] * x * (1 - x) for c, x in zip(cells, q)]
            tree = cls._grow(cells, grad, hess, list(range(len(cells))), depth)
            model.trees.append(tree)
            f = [v + rate * cls._value(tree, c[0]) for v, c in zip(f, cells)]
        return model

    @classmethod
    def _grow(cls, cells, grad, hess, rows, depth):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        leaf, best = g / (h + 1), (1e-6, None, None)
        if depth and rows:
            for j, bins in enumerate(FEATURES.values()):
                gs, hs = [0.0] * bins, [0.0] * bins
                for i in rows:
                    gs[cells[i][0][j]] += grad[i]
                    hs[cells[i][0][j]] += hess[i]
                gl = hl = 0.0
                for cut in range(bins - 1):
                    gl, hl = gl + gs[cut], hl + hs[cut]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, j, cut)
        if best[1] is None:
            return leaf
        _, j, cut = best
        sides = [[i for i in rows if (cells[i][0][j] <= cut) is low] for low in (True, False)]
        return (j, cut, *(cls._grow(cells, grad, hess, s, depth - 1) for s in sides))

    @classmethod
    def _value(cls, tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def predict(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.bias - self.rate * sum(self._value(t, x) for t in self.trees)))

    def column(self, x: Column) -> Column:
        """The same number as an expression on a struct with the features."""
        names = list(FEATURES)

        def of(tree) -> Column:
            return F.when(x[names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + self.rate * of(tree)
        return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class Model:
    """Trees, and for each kind the least score that is selected."""

    trees: Boosted
    least: dict[int, float]

    def selects(self, x: Column) -> Column:
        cut = F.lit(2.0)
        for k, v in self.least.items():
            cut = F.when(x["k"] == k, v).otherwise(cut)
        return self.trees.column(x) >= cut


def threshold(model: Boosted, cells: list, precision: float) -> float:
    """Least score whose calibrated share of true candidates reaches ``precision``.

    The calibration is isotonic: neighbouring scores are pooled until shares rise with the score.
    """
    by: dict[float, list[float]] = {}
    for x, n, p in cells:
        s = by.setdefault(round(model.predict(x), 9), [0.0, 0.0])
        s[0], s[1] = s[0] + n, s[1] + p
    pools: list[list[float]] = []
    for s in sorted(by):
        pools.append([s, *by[s]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, p = pools.pop()
            pools[-1][1:] = [pools[-1][1] + n, pools[-1][2] + p]
    return min((s - 1e-9 for s, n, p in pools if p >= precision * n), default=2.0)


def _with_check_digit(rng: random.Random, size: int, holds: bool) -> str:
    d = [rng.randrange(1, 10)] + [rng.randrange(10) for _ in range(size - 2)]
    total = sum(v * 2 - 9 * (v * 2 > 9) if i % 2 == 0 else v for i, v in enumerate(reversed(d)))
    return "".join(map(str, d)) + str((-total + (0 if holds else rng.randrange(1, 10))) % 10)


def _example(rng: random.Random) -> tuple[str, str, str, int]:
    """(words before, item, words after, place of its kind or -1 for a false one)."""
    letters = lambda n, of="abcdefghijklmnoprstuvw": "".join(rng.choice(of) for _ in range(n))
    word = lambda: letters(rng.randrange(2, 9))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: letters(n, "0123456789abcdef")
    mixed = lambda n: letters(n - 3, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") + "a7Q"
    true = rng.random() < 0.5
    kind = rng.randrange(len(ALL_KINDS))
    lead = rng.choice(("", "", "id: ", "order ", "no ", "see "))
    if kind == 0:
        lead = rng.choice(("", "", "mail: ", "contact "))
        if true:
            at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), (" (at) ", ".")))
            item = f"{word()}{rng.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'info'))}"
        else:
            item = rng.choice((f"{num(1)} @ {num(1)}.{num(2)}", f"{word()} @ {word()}", f"{word()} (at) {num(2)}", f"{word()}@{word()}"))
    elif kind == 1:
        part = lambda: str(rng.randrange(256) if true else rng.randrange(256, 1000))
        lead = rng.choice(("", "", "ip ", "host ", "server ")) if true else lead
        item = rng.choice((" . ", "[.]", "(.)", ". ", " .")).join(part() for _ in range(4))
    elif kind == 2:
        d = _with_check_digit(rng, rng.choice((15, 16, 16, 16, 19)), true)
        lead = rng.choice(("", "card ", "visa: ", f"{num(2)} ", f"payment {num(1)} ")) if true else rng.choice((lead, "card ", f"{num(2)} "))
        item = rng.choice((d, ".".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))))
    elif kind == 3:
        if true:
            form = rng.randrange(4)
            item = (f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"0049 {num(2)} {num(7)}", f"+{rng.randrange(1, 10)} ({num(3)}) {num(3)}-{num(4)}")[form]
            lead = rng.choice(("tel ", "phone: ", "call ", "fax ", "")) if form in (0, 3) else rng.choice(("tel ", "phone: ", "mobile "))
        else:
            item = rng.choice((f"{rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1900, 2030)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)}-{num(4)}", f"{num(2)}.{num(3)}", f"{num(3)} {num(3)}", f"{num(2)}/{num(4)}"))
            lead = rng.choice((lead, "date ", "isbn ", "section "))
    else:
        item = rng.choice((hexes(40), hexes(32), hexes(64), mixed(24), mixed(40)))
        lead = rng.choice(('token = "', "token: ", "api_key=", "secret = '", "password: ", "Bearer ")) if true else rng.choice(("commit ", "sha1 ", "hash ", f"{word()}/", "", "id "))
        if not true and rng.random() < 0.4:
            item = f"{word()}-{word()}-{word()}-{num(2)}-{word()}{word()}"
    before = " ".join(word() for _ in range(rng.randrange(0, 5)))
    return (before + " " if before else "") + lead, item, rng.choice((".", "", ",", '"')) + " " + word(), kind if true else -1


def examples(spark: SparkSession, n: int = 4000, seed: int = 5) -> DataFrame:
    """``n`` labelled sentences (place, text, s, e, kind): one item each at code points s to e, kind -1 for false ones."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        before, item, after, kind = _example(rng)
        rows.append("\x1f".join((before + item + after, str(len(before)), str(len(before) + len(item)), str(kind))))
    row = F.split(F.col("col"), "\x1f")
    lines = spark.range(1).select(F.posexplode(F.split(F.lit("\x1e".join(rows)), "\x1e")))
    return lines.select(F.col("pos").alias("place"), row[0].alias("text"), *(row[i + 1].cast("int").alias(c) for i, c in enumerate(("s", "e", "kind"))))


def fit(labelled: DataFrame, precision: float = 0.9) -> Model:
    """Trees on the even places of ``labelled`` (see ``examples``), thresholds from the odd ones.

    A candidate is true if it covers the item of its kind with at most two characters more; one that
    covers a part of it is left out. Only counts of feature vectors reach the driver, at most a few
    for each example.
    """
    names = list(FEATURES)
    found = labelled.select("*", F.explode(candidates(F.col("text"), F.col("text").rlike("[0-9]"))).alias("c"))
    true = (F.col("c.k") == F.col("kind")) & (F.col("c.s") <= F.col("s")) & (F.col("c.e") >= F.col("e")) & (F.col("c.e") - F.col("c.s") <= F.col("e") - F.col("s") + 2)
    part = (F.col("c.k") == F.col("kind")) & (F.col("c.s") < F.col("e")) & (F.col("s") < F.col("c.e")) & ~true
    counted = found.where(~part).groupBy((F.col("place") % 2).alias("odd"), F.col("c.k").alias("k"), *(F.col(f"c.{x}").alias(x) for x in names)).agg(F.count("*").alias("n"), F.sum(F.coalesce(true, F.lit(False)).cast("int")).alias("p"))
    cells = [(r["odd"], r["k"], (tuple(r[x] for x in names), float(r["n"]), float(r["p"]))) for r in counted.collect()]
    trees = Boosted.fit([c for odd, _, c in cells if not odd], rounds=40, depth=4)
    return Model(trees, {k: threshold(trees, [c for odd, kind, c in cells if odd and kind == k], precision) for k in range(len(ALL_KINDS))})


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None, precision: float = 0.9) -> DataFrame:
    """``(doc_id, base, spans)``: arrays of (s, k, e), one row per input row.

    Offsets are code points, the end exclusive, k the place in ALL_KINDS (KINDS for base spans). A
    null or empty text has no spans; null and repeated keys are kept as they are; other columns are
    ignored. Without ``model`` one is fitted on ``examples``. Of overlapping additions the first stays.
    """
    model = model or fit(examples(docs.sparkSession), precision)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    based = rows.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("base", base_spans(F.col("text"), F.col("digit")))

    def add(base: Column, found: Column) -> Column:
        chosen = F.filter(found, model.selects)
        bare = F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
        return F.array_sort(F.filter(bare, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))

    def merge(base: Column, new: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))
        first = F.aggregate(new, start, lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc), lambda acc: acc["out"])
        return F.array_sort(F.concat(base, first))

    both = F.struct(F.col("base").alias("base"), candidates(F.col("text"), F.col("digit")).alias("found"))
    # one-element transforms bind each array once
    made = F.transform(F.transform(F.array(both), lambda x: F.struct(x["base"].alias("base"), add(x["base"], x["found"]).alias("new"))), lambda x: F.struct(x["base"].alias("base"), merge(x["base"], x["new"]).alias("spans")))[0]
    return based.select("doc_id", made.alias("made")).select("doc_id", "made.base", "made.spans")


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
