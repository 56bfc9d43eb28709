"""Secret scans with a random forest that removes false positives.

Candidates are long runs of key characters, values assigned to a key word and passwords in URLs. Each gets features of its length, its characters'
transitions (mean log-probability under a model of ordinary words, entropy, shares of digits and
cases), its coverage by dictionary words, whether it is part of a path or URL, and its
neighbouring words. A random forest trained here on labelled findings decides which candidates
are secrets. Training data is a bounded table of findings (text before, candidate, text after,
label); ``labelled_findings`` makes one from a seed, and other labelled findings can be given.

Every text is scanned whole. Null and empty texts have no findings. Rows are independent; repeated
rows repeat their findings. Offsets are code points, half-open.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Candidates: key characters, at least 16, with a digit or a sign among them; or an assigned value of at least 8.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_=\-]*[0-9+/_=\-])[A-Za-z0-9+/_\-]{16,}={0,2}|(?<=[\"'=:])[A-Za-z0-9!@#$%^&*+/_\-]{8,}(?=[\"'])")
#: Further candidates: any value of at least 8 after a key word and = or :, quoted or not, and the password of a URL.
ASSIGNED = re.compile(r"(?i:token|secret|password|passwd|passphrase|pass|pwd|key|auth|bearer|credentials?)[\"']?[ \t]*(?:=>|:=|[=:])[ \t]*[\"']?((?:(?!&\w+=)[^\s\"'`<>,;]){8,})")
URL_PASSWORD = re.compile(r"://[^\s:/@\"'<>]*:([^\s/\"'<>]{4,})@")
AROUND = 48
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "bearer", "credential", "access", "private")
SAFE_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision", "example", "integrity", "data", "id")
FOREST_TREES, FOREST_DEPTH = 24, 9
TRAIN_ROWS = 6000
KEEP = 0.5

WORDS = "the and that have for not with you this but from they say her she will one all would there their what out about who get which when make can like time just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us user file name value path index data config service request response message server client version build release system default option table column record status handler manager factory builder controller static public private return string number object".split()


def transition_model() -> dict[str, float]:
    """Log-probabilities of letter pairs in ordinary words."""
    pairs: Counter = Counter()
    first: Counter = Counter()
    for w in WORDS:
        x = f"^{w}$"
        pairs.update(x[i : i + 2] for i in range(len(x) - 1))
        first.update(x[:-1])
    return {p: math.log((c + 0.1) / (first[p[0]] + 4)) for p, c in pairs.items()}


PAIRS = transition_model()
LONG_WORDS = tuple(sorted({w for w in WORDS if len(w) >= 4}, key=len, reverse=True))


def features(before: str, candidate: str, after: str) -> list[float]:
    low = candidate.lower()
    n = len(candidate)
    pairs = [PAIRS.get(low[i : i + 2], -5.0) for i in range(n - 1)]
    counts = Counter(candidate).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    covered = rest = low
    for w in LONG_WORDS:
        if w in rest:
            rest = rest.replace(w, "\0")
    covered = n - len(rest.replace("\0", ""))
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    near = set(re.findall(r"[a-z0-9]+", before.lower()[-AROUND:]))
    path = ("/" in candidate) + ("://" in before[-20:]) + bool(re.search(r"[\w.]/$|\\$", before)) + bool(re.match(r"\.\w{2,4}\b|/", after))
    return [
        n,
        sum(pairs) / max(len(pairs), 1),
        entropy,
        covered / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("s") / n,
        changes,
        path,
        float(any(k in w for w in near for k in KEY_WORDS)),
        float(any(k in near for k in SAFE_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", candidate))),
        float(len(set(low)) <= 4),
        float(after[:1] == "@" and "://" in before),
        float(bool(re.match(r"[$%]?[{(]|\$[A-Za-z_]|%\w+%|\w+(?:\.\w+)*[(\[]", candidate))),
    ]


def labelled_findings(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, is_secret) of the kinds that scanners report."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexa, digits = "0123456789abcdef", "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = upper + upper.lower() + digits
    word = lambda: r.choice(WORDS) if r.random() < 0.5 else pick("etaoinshrdlu", r.randint(3, 9))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = []
    for _ in range(rows // 4):
        key = r.choice(("token", "api_key", "secret", "password", "AUTH_TOKEN", "access_key", "client_secret", "apikey"))
        mark = r.choice((" = ", "=", ": ", ":"))
        quote = r.choice(('"', "'", ""))
        value = r.choice((pick(hexa, r.choice((32, 40, 64))), pick(alnum, r.randint(20, 48)), "AKIA" + pick(upper + digits, 16), "ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 40), pick(alnum + "+/", 40) + "=" * r.choice((0, 1, 2)), pick(alnum + "!@#$%", r.randint(10, 16))))
        out.append((f"{prose(3)} {key}{mark}{quote}", value, f"{quote} {prose(2)}", 1))
        # values without quotes and passwords of URLs, and what stands in their places
        phrase = "".join(r.choice((word(), word().capitalize())) for _ in range(r.randint(1, 2))) + pick(digits + "!@#$%^&", r.randint(1, 3)) + pick(alnum, r.randint(0, 4))
        bare = r.choice((pick(alnum + "!@#$%^&", r.randint(8, 16)), pick(upper.lower(), r.randint(14, 32)), upper.lower()[: r.randint(16, 26)], phrase if len(phrase) >= 8 else pick(alnum, 10)))
        if r.random() < 0.25:
            out.append((f"{prose(3)} {r.choice(('https', 'postgres', 'ftp', 'redis'))}://{word()}:", r.choice((bare, pick(alnum, r.randint(8, 12)))), f"@{word()}.org {prose(2)}", 1))
        else:
            out.append((f"{prose(3)} {r.choice(('', 'db_', 'DB_'))}{r.choice((key, 'pwd', 'passwd'))}{mark}", bare, f" {prose(2)}", 1))
        plain = max((word() for _ in range(9)), key=len)
        filler = r.choice((plain, f"{plain}.", "".join((plain, word())), f"${plain.upper()}", f"${{{plain}}}", f"${{{word().upper()}_{plain.upper()}}}", f"${word().upper()}_{plain.upper()}", f"{plain}({word()})", f"os.environ[{word()}]", f"{word()}.{plain}.{word()}", "*" * r.randint(8, 12), "required", "undefined", "something", "/".join(("", word(), plain))))
        out.append((f"{prose(3)} {r.choice((key, 'pwd', 'key'))}{mark}", filler, f" {prose(2)}", 0))
        kind = r.randrange(8)
        before, after = f"{prose(4)} ", f" {prose(3)}"
        if kind == 0:
            value = "-".join(word() for _ in range(r.randint(4, 7)))
        elif kind == 1:
            value, before = "/".join(word() for _ in range(r.randint(4, 7))), before + r.choice(("", "/", "https://"))
        elif kind == 2:
            value, before = pick(hexa, r.choice((32, 40, 64))), f"{prose(2)} {r.choice(('commit', 'sha256', 'md5', 'checksum', 'revision', 'etag'))}{r.choice((': ', ' ', '='))}"
        elif kind == 3:
            value, before = f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", f"{prose(2)} {r.choice(('id', 'uuid', 'guid'))}{r.choice((' = ', ': '))}"
        elif kind == 4:
            value = pick(digits, r.randint(16, 22))
        elif kind == 5:
            value, before = pick("x*-_="[r.randrange(5)], r.randint(16, 40)), before + r.choice(("", "token = "))
        elif kind == 6:
            value = "_".join(word() for _ in range(r.randint(3, 6))) + pick(digits, r.randint(0, 3))
        else:
            value, before = "your-" + "-".join(word() for _ in range(3)) + "-here", f"{prose(2)} token = \""
        out.append((before, value, after, 0))
    return out


@dataclass
class Forest:
    """Trees as parallel arrays: feature (-1: leaf), threshold, children and the leaf's share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(FOREST_DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def _best_cut(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    n, ones = len(y), y.sum()
    base = ones * (n - ones) / n
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        gain = base - c * (k - c) / k - (ones - c) * ((n - k) - (ones - c)) / (n - k)
        gain[v[:-1] == v[1:]] = 0
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best[0] + 1e-9:
            middle = float((v[i] + v[i + 1]) / 2)
            # neighbouring floats have no number between them
            best = (float(gain[i]), int(f), middle if middle < v[i + 1] else float(v[i]))
    return best


def train(findings: list[tuple[str, str, str, int]], seed: int = 5) -> Forest:
    x = np.array([features(b, c, a) for b, c, a, _ in findings])
    y = np.array([f[3] for f in findings], float)
    rng = np.random.default_rng(seed)
    width = max(1, int(math.sqrt(x.shape[1]) + 0.5))
    trees = []
    for _ in range(FOREST_TREES):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def grow(idx: np.ndarray, depth: int, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[idx].mean())])
            if depth < FOREST_DEPTH and len(idx) >= 4 and 0 < nodes[me][4] < 1:
                _, f, cut = _best_cut(x[idx], y[idx], rng.choice(x.shape[1], width, replace=False))
                if f >= 0:
                    low = x[idx, f] <= cut
                    nodes[me][:2] = f, cut
                    nodes[me][2] = grow(idx[low], depth + 1)
                    nodes[me][3] = grow(idx[~low], depth + 1)
            return me

        grow(rows, 0)
        a = np.array(nodes)
        trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(trees)


def find(text: str) -> list[tuple[int, int, list[float]]]:
    """(start, end, features) of every candidate; candidates can overlap."""
    spans = {m.span() for m in CANDIDATE.finditer(text)}
    for m in (*ASSIGNED.finditer(text), *URL_PASSWORD.finditer(text)):
        s, e = m.span(1)
        spans.add((s, s + len(text[s:e].rstrip(".,:") if m.re is ASSIGNED else text[s:e])))
    out = []
    for s, e in sorted(x for x in spans if x[0] < x[1]):
        out.append((s, e, features(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND])))
    return out


def apart(rows: list[int], places: list[tuple[int, int]], p: np.ndarray) -> list[int]:
    """Of overlapping findings in a row of the batch, the longest (ties: the likeliest)."""
    taken: dict[int, list[tuple[int, int]]] = {}
    out = []
    for k in sorted(range(len(rows)), key=lambda k: (places[k][0] - places[k][1], -p[k], places[k][0])):
        s, e = places[k]
        if all(e <= a or b <= s for a, b in taken.setdefault(rows[k], [])):
            taken[rows[k]].append((s, e))
            out.append(k)
    return sorted(out)


def scan(docs: DataFrame, forest: Forest | None = None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, start, end, probability of every finding that the forest keeps."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or train(labelled_findings()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for b in batches:
            ids, rows, places, x = [], [], [], []
            for row, (doc_id, t) in enumerate(zip(b["doc_id"], b["text"])):
                for s, e, f in find(t or ""):
                    ids.append(doc_id)
                    rows.append(row)
                    places.append((s, e))
                    x.append(f)
            if not x:
                continue
            p = model.predict(np.array(x, float))
            hit = np.flatnonzero(p >= keep)
            hit = hit[apart([rows[k] for k in hit], [places[k] for k in hit], p[hit])] if len(hit) else hit
            at = np.array(places)[hit]
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64")[hit].values, "start": at[:, 0], "end": at[:, 1], "probability": np.round(p[hit], 6)})

    rows = docs.select("doc_id", docs[text].alias("text")).filter("text is not null")
    return rows.mapInPandas(run, "doc_id long, start long, end long, probability double")


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs)
