"""Secret scans: base patterns, and a character convolutional network over every further candidate in its context.

Candidates are all runs of MIN_RUN or more characters of ``[A-Za-z0-9+/_.=-]`` that hold a digit and a letter, and, right
after a word that announces a secret (HINTED), runs of MIN_HINTED or more of any of these characters. The network reads
windows of WINDOW characters: INSIDE from a place in the candidate on, the BEFORE characters before these and the AFTER
behind them; characters of the candidate and of its context have codes of their own. A candidate of up to INSIDE
characters has one window, a longer one overlapping ones from its head to its tail, so all of it and the text on both
sides is read; its score is its windows' highest. The network embeds character classes, convolves, pools and gives a
logit; it is a few thousand numbers. It learns from labelled findings: secrets are base matches in a bounded, hash-chosen sample of documents (``max_train_docs``) and generated ones;
harmless are generated runs and those of the sample that have a strict harmless shape (host names, dates, versions).
Other candidates of the sample may be secrets that the base patterns miss, so they are not used. Windows are bounded by
hash too (``MAX_TRAIN_WINDOWS``), and the fit is one task. Short secrets after announcing words, and plain words there,
are generated as well. Held-back generated findings of kinds that the base patterns
miss calibrate the logit (Platt) and set the threshold: the highest one that keeps TARGET_RECALL of those secrets. Base
spans always stay; candidates over the threshold, or what base spans leave over of them, are added as kind ``net``.

Defined results: a null or empty text has no spans; whole texts are read; spans are in code points, end exclusive, where
each run of bytes that is not UTF-8 counts as one; ties and overlaps of base kinds all stay; ``net`` never overlaps them;
repeated rows are scanned one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_RUN, MIN_HINTED = 16, 8
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
HINTED = re.compile(rf"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|credentials?|bearer)["']?(?:\x20(?:is|was))?[\x20:=>"']{{1,6}}([A-Za-z0-9+/_.=-]{{{MIN_HINTED},}})""", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "net")
KEYWORDS = (b"password", b"passwd", b"passphrase", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"bearer")
#: Runs that are harmless by their shape alone: dates and times, versions, host names of plain words.
HARMLESS = re.compile(
    r"""(?:19|20)\d\d-[01]\d-[0-3]\d(?:[T_-][0-2]\d[.-]?[0-5]\d[.-]?[0-5]\d(?:\.\d{1,6})?Z?)?(?:[._-][a-z]{2,9}){0,4}"""
    r"""|[vV]?\d{1,3}(?:\.\d{1,4}){1,3}(?:[-.+_](?:[a-z]{2,9}|\d{1,3})){0,5}"""
    r"""|(?:(?:[a-z]{2,9}|[a-z]{1,6}\d{1,3})[.-]){1,5}(?:com|org|net|io|de|fr|es|uk|eu|edu|gov|example|local|internal)\.?""",
    re.ASCII,
)
MAX_TRAIN_DOCS, MAX_TRAIN_WINDOWS = 5_000, 20_000
TARGET_RECALL = 0.95
BEFORE, INSIDE, AFTER = 16, 32, 16
WINDOW = BEFORE + INSIDE + AFTER
CHANNELS, WIDTH, EPOCHS, RATE = 16, 5, 24, 0.01
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True

Span = tuple[int, int, str]


def _classes() -> np.ndarray:
    """Characters by class: padding, each ASCII punctuation mark, digits, a-f, g-z, A-F, G-Z, blanks, the rest."""
    out = np.full(128, 7, np.int8)
    out[48:58], out[97:103], out[103:123], out[65:71], out[71:91] = 1, 2, 3, 4, 5
    out[[9, 10, 11, 12, 13, 32]] = 6
    for k, c in enumerate("+/_.=-:\"'@"):
        out[ord(c)] = 8 + k
    return out


CLASS = _classes()
#: Codes of a candidate's characters are under CONTEXT, those of its context CONTEXT more.
CONTEXT = 18
N_CLASSES = 2 * CONTEXT


def base_spans(text: str) -> list[Span]:
    """The base findings of a whole text, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _has_run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows hold a run of 16 or more candidate bytes (every access and hex finding lies in one)."""
    inside = _RUN[data]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_run = ends - starts >= 16
    # a run that goes over the end of a row belongs to both rows; the exact patterns decide
    rows = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(starts[long_run], ends[long_run], strict=True):
        rows[np.searchsorted(offsets, a, "right") - 1 : np.searchsorted(offsets, b, "left")] = True
    return rows


def _fast_base(text: str) -> list[Span]:
    """base_spans for a text that is known to be worth reading: hex and access runs are sought by length at once."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]{12,}", text)]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{32,}", text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append((m.start(), m.end()))
    starts = [s for s, _ in out]

    def free(span: tuple[int, int]) -> bool:
        """Whether none of the runs, which are apart and in order, meets the span."""
        before = bisect.bisect_left(starts, span[1]) - 1
        return before < 0 or out[before][1] <= span[0]

    near = [m.span(1) for m in HINTED.finditer(text) if free(m.span(1))]
    return sorted(out + near) if near else out


def rests(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """The candidates of a text, and in place of those that touch base spans what these leave over, if it is a candidate too.

    Both are in order of their starts and are merged; spans of one kind are apart, so few are open at once.
    """
    out, open_, following = [], [], 0
    for start, end in candidates(text):
        open_ = [x for x in open_ if x[1] > start]
        while following < len(base) and base[following][0] < end:
            if base[following][1] > start:
                open_.append(base[following])
            following += 1
        at = start
        for s, e, _ in [*sorted(open_), (end, end, "")]:
            if (at, s) == (start, end) or s - at >= MIN_RUN and any(c.isdigit() for c in text[at:s]) and any(c.isalpha() for c in text[at:s]):
                out.append((at, s))
            at = max(at, e)
    return out


def places(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin."""
    half = INSIDE // 2
    return [start] if end - start <= INSIDE else [*range(start, end - INSIDE, half), end - INSIDE]


def codes(text: str) -> np.ndarray:
    """Class codes of a text as context, with padding on both sides, so that a window at ``at`` begins at ``at``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + WINDOW, np.int8)
    out[BEFORE : BEFORE + len(points)] = np.where(points < 128, CLASS[np.minimum(points, 127)], 7) + CONTEXT
    return out


def encode(coded: np.ndarray, at: int, start: int, end: int) -> np.ndarray:
    """The window at ``at`` of the candidate from ``start`` to ``end``: its own characters lose the mark of context."""
    window = coded[at : at + WINDOW].copy()
    low, high = max(0, start - at + BEFORE), min(WINDOW, end - at + BEFORE)
    window[low:high] -= CONTEXT
    return window


def secret_places(run: tuple[int, int], secret: tuple[int, int]) -> list[int]:
    """Those windows of a run that show enough of a secret in it to be told by."""
    need = min(INSIDE // 2, secret[1] - secret[0], run[1] - run[0])
    return [at for at in places(*run) if min(at + INSIDE, secret[1], run[1]) - max(at, secret[0], run[0]) >= need]


class CharNet:
    """Embedded classes, one convolution of width WIDTH, ReLU, max and mean pooling, one logit."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "k": rng.normal(0, 0.3, (WIDTH, N_CLASSES, CHANNELS)).astype(np.float32),
            "c": np.zeros(CHANNELS, np.float32),
            "v": rng.normal(0, 0.3, 2 * CHANNELS).astype(np.float32),
            "b": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        n = WINDOW - WIDTH + 1
        h = self.p["c"] + sum(self.p["k"][j][x[:, j : j + n]] for j in range(WIDTH))
        a = np.maximum(h, 0)
        top = a.argmax(1)
        pooled = np.hstack([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(1)])
        return h, a, top, pooled, pooled @ self.p["v"] + self.p["b"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 2048])[-1] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -35, 35)))

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, a, top, pooled, z = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)).astype(np.float32)
        g = d[:, None] * self.p["v"]
        da = np.repeat(g[:, None, CHANNELS:] / a.shape[1], a.shape[1], 1)
        rows = np.arange(len(x))[:, None]
        da[rows, top, np.arange(CHANNELS)] += g[:, :CHANNELS]
        da *= h > 0
        shown = np.eye(N_CLASSES, dtype=np.float32)[x]
        k = np.stack([np.tensordot(shown[:, j : j + a.shape[1]], da, ((0, 1), (0, 1))) for j in range(WIDTH)])
        return {"k": k, "c": da.sum((0, 1)), "v": pooled.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 5) -> CharNet:
        """Adam; calibration and threshold on ``held``, or on a third of the rows that is then not learnt from."""
        rng = np.random.default_rng(seed)
        used = rng.permutation(len(x))
        if held is None:
            held, used = (x[used[: len(x) // 3]], y[used[: len(x) // 3]]), used[len(x) // 3 :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for i in range(0, len(used), 128):
                step += 1
                part = used[i : i + 128]
                for k, g in self._gradient(x[part], y[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logits(held[0]), held[1]
        for _ in range(200):  # Platt: scale and shift by gradient steps
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -35, 35)))
            self.scale -= 0.05 * float(((p - t) * z).mean())
            self.shift -= 0.05 * float((p - t).mean())
        secrets = np.sort(self.probability(held[0][t == 1]))
        self.threshold = float(secrets[int(len(secrets) * (1 - TARGET_RECALL))]) if len(secrets) else 0.5
        return self


#: How keys of some providers begin.
PREFIXES = ("ghp_", "gho_", "sk_live_", "pk_live_", "sk-", "xoxb-", "glpat-", "AIza", "npm_", "pypi-")


def generated_findings(n: int = 600, seed: int = 11, missed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up secrets (1) and of harmless long runs (0): names, paths, hosts, dates, versions, counters.

    ``missed``: only secrets that the base patterns miss, half of them with a provider's prefix, a third inside a path.
    """
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    leads = ("key = ", "token: ", 'secret="', "auth: Bearer ", "the ", "", "export KEY=", "id ")
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    harmless = (
        lambda: ".".join(word() for _ in range(4)) + f".{rng.integers(1, 99)}",
        lambda: "/".join(word() for _ in range(4)) + f"/{rng.integers(1, 9999)}",
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}_{word()}-{word()}",
        lambda: f"v{rng.integers(1, 20)}.{rng.integers(0, 50)}.{rng.integers(0, 50)}-{word()}-{word()}",
        lambda: f"{word()}.{rng.integers(1, 999)}_{word()}.example.com",
        lambda: "".join(word() for _ in range(4)) + str(rng.integers(1, 99)),
        lambda: str(rng.integers(10**15, 10**18)) + word(),
        lambda: f"{word()}-{word()}-{word()}-{word()}-{rng.integers(1, 99)}",
    )
    x, y = [], []
    for k in range(n):
        label = k % 2
        body = "".join(rng.choice(list(alphabets[rng.integers(len(alphabets))]), rng.integers(20, 60))) if label else harmless[rng.integers(len(harmless))]().ljust(16, "1")
        before = f"{word()} {word()} " + (leads[rng.integers(len(leads))] if label or rng.random() < 0.3 else "")
        if label and missed and rng.random() < 0.5:
            body = PREFIXES[rng.integers(len(PREFIXES))] + body
        head, tail = "", ""
        if missed and rng.random() < 0.33:
            head, tail = f"//{word()}.example/{word()}/v{rng.integers(1, 9)}/", "".join(f"/{word()}" for _ in range(rng.integers(0, 5)))
        text = f"{before}{head}{body}{tail} {word()} {word()}"
        if label and missed and base_spans(text):
            continue
        start = len(before) + len(head)
        run, secret = (len(before), start + len(body) + len(tail)), (start, start + len(body))
        coded = codes(text)
        for at in secret_places(run, secret) if label else places(*run):
            x.append(encode(coded, at, *run))
            y.append(label)
    return np.array(x), np.array(y, float)


def hinted_findings(n: int = 400, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Windows of short made-up secrets (1) and of plain words (0), each right after a word that announces a secret."""
    rng = np.random.default_rng(seed)
    leads = ("password is ", "the password: ", "token ", "pwd ", "secret ", "bearer ", 'credential "', "passphrase ", "secret: ", "Token ")
    mixed, digits, upper, lower = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789", "0123456789", "BCDFGHJKLMNPQRSTVWXZ0123456789", "etaoinshrdlumcw"
    pick = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    plain = (lambda: pick(lower, 8, 14), lambda: pick(lower, 8, 14) + ".", lambda: pick(lower, 8, 12).capitalize(), lambda: f"{pick(lower, 4, 8)}-{pick(lower, 4, 8)}", lambda: f"{pick(lower, 4, 7)}.{pick(lower, 4, 7)}")
    x, y = [], []
    for k in range(n):
        label = k % 2
        body = pick((mixed, mixed, digits, upper)[rng.integers(4)], 8, 16) if label else plain[rng.integers(len(plain))]()
        before = f"{pick(lower, 2, 7)} {leads[rng.integers(len(leads))]}"
        run = (len(before), len(before) + len(body))
        x.append(encode(codes(f"{before}{body} {pick(lower, 2, 7)} {pick(lower, 2, 7)}"), run[0], *run))
        y.append(label)
    return np.array(x), np.array(y, float)


def _collect_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.text_slices(batches, 0):
        x, y = [], []
        for text in common.texts(batch.column(0)):
            base, coded = base_spans(text), codes(text)
            for a, b in candidates(text):
                secret = sorted({at for s, e, _ in base if a < e and s < b for at in secret_places((a, b), (max(a, s), min(b, e)))})
                for at in secret or (places(a, b) if HARMLESS.fullmatch(text, a, b) else []):
                    x.append(encode(coded, at, a, b).tobytes())
                    y.append(float(bool(secret)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.float64())], ["x", "y"])


def fit(documents: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> CharNet:
    """A network learnt from about ``max_train_docs`` documents at most and the generated findings."""
    share = max_train_docs / max(1, documents.count())
    sample = documents.filter(F.col("text").isNotNull() & common.in_sample(share, "doc_id", F.lit("secrets")))
    found = common.materialize(sample.select("text").mapInArrow(_collect_findings, "x binary, y double").groupBy("x").agg(F.max("y").alias("y")))
    windows = found.filter(common.in_sample(MAX_TRAIN_WINDOWS / max(1, found.count()), "x", F.lit("windows")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y"] >= 0].sort_values("x")
        made = [generated_findings(), generated_findings(1200, 12, missed=True), hinted_findings()]
        seen = np.frombuffer(b"".join(bytes(v) for v in pdf["x"]), np.int8).reshape(-1, WINDOW)
        x, y = np.vstack([*(m[0] for m in made), seen]), np.concatenate([*(m[1] for m in made), pdf["y"].to_numpy()])
        held = [np.concatenate(v) for v in zip(generated_findings(1200, 13, missed=True), hinted_findings(200, 18), strict=True)]
        return pd.DataFrame({"net": [pickle.dumps(CharNet().fit(x, y, tuple(held)))]})

    # a row that is no finding: without any, the network still learns from what is generated
    none = documents.sparkSession.range(1).select(F.lit(b"").alias("x"), F.lit(-1.0).alias("y"))
    return pickle.loads(windows.unionByName(none).withColumn("shard", F.lit(0)).groupBy("shard").applyInPandas(learn, "net binary").first()["net"])


def find_secrets(documents: DataFrame, net: CharNet | None) -> DataFrame:
    """doc_id and spans array<struct<start, end, kind, score>> of every row; base spans have score 1. Without a network, these alone."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.text_slices(batches, 1):
            column = batch.column(1)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            asked, where, first = [], [], []
            for low, high, data, offsets in common.blocks(column):
                worth = _has_run(data, offsets)
                folded = data.tobytes().lower()
                for k in range(high - low):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    if not worth[k] and not any(folded.find(w, a, b) >= 0 for w in KEYWORDS):
                        continue
                    text = data[a:b].tobytes().decode("utf-8", "replace")
                    base = _fast_base(text)
                    spans[low + k] = [{"start": s, "end": e, "kind": kind, "score": 1.0} for s, e, kind in base]
                    left = rests(text, base) if model else []
                    coded = codes(text) if left else None
                    for s, e in left:
                        first.append(len(asked))
                        asked += [encode(coded, at, s, e) for at in places(s, e)]
                        where.append((low + k, s, e))
            if asked:
                for (row, s, e), p in zip(where, np.maximum.reduceat(model.probability(np.array(asked)), first), strict=True):
                    if p >= model.threshold:
                        spans[row].append({"start": s, "end": e, "kind": "net", "score": float(p)})
            for found in spans:
                found.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,end:long,kind:string,score:double>>")


def scan(documents: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """find_secrets by a network learnt from the same documents."""
    return find_secrets(documents, fit(documents.select("doc_id", "text"), max_train_docs))


def base_findings(documents: DataFrame) -> DataFrame:
    """find_secrets by the base patterns alone."""
    return find_secrets(documents, None)


ORACLE = r"""
SELECT doc_id,
  len([x FOR x IN regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 8])::BIGINT AS n_assign,
  len([x FOR x IN regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+') IF length(x) >= 16])::BIGINT AS n_access,
  len([x FOR x IN regexp_extract_all(coalesce(text, ''), '[0-9a-f]+') IF length(x) >= 32])::BIGINT AS n_hex
FROM documents
"""
