"""Personal data: base rules, and candidate spans judged by boosted trees.

Base spans (email, ip, card, phone) follow fixed rules and always stay. Generators propose more spans with high recall,
and these may overlap: loose e-mail, number, dotted and assignment shapes, long keys, mixed-case tokens, account and identity numbers, of any length. Each
candidate gets format features (length, character shares, entropy, check digits, grouping) and context features (cue
words before it, its neighbours); gradient-boosted trees, trained here on generated examples, give a probability, and
each generator's threshold is calibrated on held-out examples to PRECISION. Accepted spans that don't overlap a base span
are added, the likeliest first where they overlap each other.

Null and empty texts have no spans. Repeated rows give the same; other columns don't matter. Offsets are code points, ends exclusive. Rows are independent: no shuffle; what is
shipped to the tasks is the trees (a fixed number of them).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import per_worker, table

BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these never starts inside a run of digits that an earlier try has left: runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

TOKEN = "[A-Za-z0-9_+/.-]"
#: None has an upper bound of length: runs are taken whole and tried once, so they stay linear; length is a feature.
GENERATORS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]++(?:@|\s?\[at\]\s?|\(at\))[\w.-]{2,}"),
    "number": re.compile(r"[+(]?[0-9](?:[\x20().-]?[0-9]){6,}+"),
    "secret": re.compile(r"(?<![A-Za-z_])[A-Za-z_]{2,}+\x20?[=:]\x20?[\"']?[^\s\"']{8,}+"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])[A-Z0-9]{14,}+(?![A-Za-z0-9])|(?<![0-9A-Za-z])[0-9a-f]{24,}+(?![0-9A-Za-z])"),
    "identity": re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "token": re.compile(rf"(?<!{TOKEN})(?={TOKEN}*[0-9])(?={TOKEN}*[A-Z])(?={TOKEN}*[a-z]){TOKEN}{{20,}}+={{0,2}}"),
}
#: What a text must hold for a generator to find anything in it.
NEEDS = {"email": re.compile(r"@|[\[(]at"), "secret": re.compile("[=:]")}
DIGIT = re.compile("[0-9]")
#: Words that speak for or against personal data before a candidate; fixed values.
CUES = {"mail": ("mail", "contact", "write"), "call": ("call", "phone", "tel", "mobile", "fax"), "secret": ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential"), "id": ("ssn", "social", "passport", "iban", "account", "tax"), "plain": ("order", "version", "isbn", "page", "item", "section", "year", "build", "hash", "commit", "id=", "ref")}
FEATURES = 24
PRECISION, EXAMPLES, TREES, DEPTH, RATE = 0.98, 6000, 60, 3, 0.2


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) in order."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, 0, free))
        at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator number), overlapping."""
    out = []
    for k, (name, g) in enumerate(GENERATORS.items()):
        if NEEDS.get(name, DIGIT).search(text):
            out += [(m.start(), m.end(), k) for m in g.finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - 40) : start].lower()
    n = len(s)
    digits = NOT_DIGIT.sub("", s)
    value = re.split(r"[=:]\x20?[\"']?", s, maxsplit=1)[-1]
    counts = [c / len(value) for c in Counter(value).values()]
    near = before[-25:] + s[: n - len(value)].lower()
    return [
        kind, n, len(digits) / n, sum(map(str.isupper, s)) / n, sum(map(str.islower, s)) / n, -sum(p * log2(p) for p in counts), len(digits), float(luhn(digits)) if digits else 0.0,
        s.count(" "), s.count("-"), s.count("."), s.count("@"), float(s[0] == "+"), float(s[0] == "("), len(value), len({*value}),
        float(end < len(text) and text[end].isalnum()), float(start > 0 and text[start - 1].isalnum()), float("." in s.rpartition("@")[2]),
        *(float(any(c in near for c in cues)) for cues in CUES.values()),
    ]


def examples(n: int = EXAMPLES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates with labels: personal data of many formats, and look-alikes, each in a sentence."""
    rng = np.random.default_rng(seed)
    pick, digits = lambda *a: a[rng.integers(len(a))], lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(of[i] for i in rng.integers(0, len(of), k))
    word = lambda: letters(int(rng.integers(2, 9)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed, size = upper + "abcdefghijklmnopqrstuvwxyz", lambda a, b: int(np.exp(rng.uniform(np.log(a), np.log(b))))
    long_name = lambda: "_".join(pick("AZURE", "STORAGE", "CONNECTION", "CLIENT", "SERVICE", "ACCOUNT", "access") for _ in range(rng.integers(2, 5))) + pick("_SECRET", "_KEY", "_TOKEN", "_PASSWORD", "_STRING", "_key")
    yes = [
        lambda: (pick("", "mail ", "contact "), word() + pick("", ".", "_") + word() + pick("@", " [at] ", "(at)") + word() + "." + pick("com", "org", "net", "de")),
        lambda: (pick("call ", "phone: ", "tel ", ""), pick("+", "") + pick("1 ", "49 ", "33-") + "(" + digits(3) + ") " + digits(3) + "-" + digits(4)),
        lambda: (pick("call ", "phone ", "mobile "), digits(3) + pick("-", ".", " ") + digits(3) + pick("-", ".", " ") + digits(4)),
        lambda: ("", pick("password", "passwd", "token", "api_key", "secret") + pick("=", " = ", ": ") + pick('"', "") + letters(int(rng.integers(12, 40)), "0123456789abcdef")),
        lambda: ("", pick("password", "secret", "pwd") + pick("=", ": ") + word() + pick("!", "#", "") + digits(4) + word()),
        lambda: (pick("key ", "", "token "), "AK" + letters(int(rng.integers(14, 19)), upper)),
        lambda: (pick("token ", "auth ", ""), letters(int(rng.integers(32, 64)), "0123456789abcdef")),
        lambda: (pick("ssn ", "social ", ""), digits(3) + "-" + digits(2) + "-" + digits(4)),
        lambda: (pick("iban ", "account ", ""), pick("DE", "FR", "GB") + digits(2) + "".join(" " + digits(4) for _ in range(rng.integers(4, 6)))),
        lambda: ("", pick("token", "secret", "api_key", long_name()) + pick("=", ": ", ' = "') + pick("", "eyJ") + letters(size(20, 900), mixed + pick("", "-_", "+/", "."))),
        lambda: (pick("token ", "auth ", "key ", ""), pick("eyJ", "sk9", "Gh0") + letters(size(20, 900), mixed + pick("", "-_", "+/"))),
        lambda: (pick("key ", "token ", ""), pick(letters(size(64, 600), "0123456789abcdef"), "A7" + letters(size(40, 400), upper))),
        lambda: (pick("account ", "card ", "tax "), digits(size(14, 60))),
    ]
    no = [
        lambda: (pick("order ", "item ", "ref "), digits(int(rng.integers(7, 14)))),
        lambda: (pick("version ", "build "), ".".join(digits(int(rng.integers(1, 4))) for _ in range(5))),
        lambda: ("", pick("year", "page", "see", "note", "time", "title") + pick(": ", "=", " = ") + word() + word()),
        lambda: ("", pick("ratio", "count", "width", "ref") + pick("=", ": ") + digits(9)),
        lambda: (pick("isbn ", "page "), digits(3) + "-" + digits(1) + "-" + digits(4) + "-" + digits(4)),
        lambda: ("", word() + "@" + word()),
        lambda: (pick("in ", "of "), digits(4) + " " + digits(4)),
        lambda: ("", letters(int(rng.integers(14, 24)), upper[:26])),
        lambda: (pick("on ", ""), "20" + digits(2) + "-" + digits(2) + "-" + digits(2) + " " + digits(2)),
        lambda: (pick("see ", "in ", "https://", ""), pick("Docs", "Src", "www.Site") + "".join("/" + word() for _ in range(rng.integers(3, 9))) + "/" + pick("Page", "Part", "v") + digits(1)),
        lambda: (pick("order ", "item ", "ref "), digits(size(14, 60))),
        lambda: ("", pick("see", "note", "title") + pick(": ", "=") + "".join(word() + pick("-", "/", "") for _ in range(rng.integers(5, 40)))),
    ]
    x, y = [], []
    while len(y) < n:
        good = bool(rng.integers(2))
        cue, span = pick(*(yes if good else no))()
        lead = " ".join(word() for _ in range(rng.integers(0, 5)))
        text = f"{lead} {cue}{span}{pick('', '.', ', ', ' ')} {word()}"
        at = text.index(span)
        for a, b, k in candidates(text):
            if a < at + len(span) and b > at:
                x.append(features(text, a, b, k))
                y.append(good and b - a >= 0.7 * len(span))
    return np.array(x, float)[:n], np.array(y, float)[:n]


class Trees:
    """Gradient boosting of small regression trees for the logistic loss, with binned features (Friedman, 2001)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.04, 0.96, 24))) for j in range(x.shape[1])]
        self.trees, f = [], np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(x, y - p, p * (1 - p), cuts, DEPTH)
            self.trees.append(tree)
            f += RATE * self.apply(tree, x)

    def grow(self, x, g, h, cuts, depth):
        value, best = g.sum() / (h.sum() + 1), (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1)
        if depth and len(g) >= 20:
            for j, c in enumerate(cuts):
                place = np.searchsorted(c, x[:, j], "left")
                gl, hl = (np.cumsum(np.bincount(place, v, len(c) + 1))[:-1] for v in (g, h))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                if len(gain) and gain.max() > best[0]:
                    best = float(gain.max()), j, float(c[gain.argmax()])
        if best[1] is None:
            return float(value)
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self.grow(x[left], g[left], h[left], cuts, depth - 1), self.grow(x[~left], g[~left], h[~left], cuts, depth - 1)

    def apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self.apply(tree[2], x), self.apply(tree[3], x))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + RATE * sum(self.apply(t, x) for t in self.trees))))


def trained() -> tuple[Trees, list[float]]:
    """Trees, and for each generator the lowest threshold that has PRECISION on held-out examples (2 if none has)."""
    x, y = examples()
    half = len(y) * 3 // 4
    trees, limits = Trees(x[:half], y[:half]), []
    chance, x, y = trees.chance(x[half:]), x[half:], y[half:]
    for k in range(len(GENERATORS)):
        own = x[:, 0] == k
        order = np.argsort(-chance[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        limits.append(max(0.5, float(chance[own][order][ok[-1]])) if len(ok) else 2.0)
    return trees, limits


def found(texts: list[str], trees: Trees, limits: list[float]) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones, (start, kind, end)."""
    own, x, names = [], [], list(GENERATORS)
    for i, t in enumerate(texts):
        base = base_spans(t)
        # Base spans of one kind don't overlap, so the few that start last before b are all that can reach a.
        starts = {k: [z for z in base if z[1] == k] for k in range(len(BASE))} if base else {}
        for a, b, k in candidates(t):
            before = (z[bisect_left(z, (b,)) - 1] for z in starts.values() if bisect_left(z, (b,)))
            if all(e <= a for _, _, e in before):
                own.append((i, a, b, k))
                x.append(features(t, a, b, k))
        texts[i] = base
    added: list[list] = [[] for _ in texts]
    if x:
        chance = trees.chance(np.array(x, float))
        limit = np.array(limits)[[k for *_, k in own]]
        taken: list[set] = [set() for _ in texts]
        for r in sorted(np.flatnonzero(chance >= limit), key=lambda r: (-chance[r], own[r])):
            i, a, b, k = own[r]
            if taken[i].isdisjoint(range(a, b)):
                taken[i].update(range(a, b))
                added[i].append((a, names[k], b))
    return list(zip(texts, added, strict=True))


KINDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id and KINDS for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf(KINDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees, limits = per_worker("trees", lambda: model.value)
        for column in batches:
            out = []
            for base, added in found(column.fillna("").tolist(), trees, limits):
                shown = [f"{BASE[k]}:{a}:{b}" for a, k, b in base]
                # Of spans that start together base kinds come first, in their order, then generators in theirs.
                place = {k: len(BASE) + i for i, k in enumerate(GENERATORS)}
                both = sorted([(a, k, f"{BASE[k]}:{a}:{b}") for a, k, b in base] + [(a, place[k], f"{k}:{a}:{b}") for a, k, b in added])
                counts = [sum(k == j for _, k, _ in base) for j in range(4)]
                out.append((*counts, sha256(",".join(shown).encode()).hexdigest(), ",".join(s for *_, s in both), len(added)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in KINDS.split(", ")])

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")


def op3_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))
