"""Template residue and error-page text in place of real content (problem 3).

A regularised linear classifier on hashed n-grams reads a page piece by piece: its title, and each
sentence of its opening text. It is trained here, on weak labels only: what pages without a 2xx
status say (they are error pages), and phrases that leave no doubt. It is fitted on every labelled
piece, where the pieces lie, and validated on every one of hosts it has not seen.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from seamark.functions.page_key import key_host, page_key
from seamark.plans.skew import lookup_join
from seamark.session import cut, cut_table

#: Labelled pieces that a worker handles together at most. All are used; the model does not depend on it.
BLOCK = 10_000
#: Blocks that a task goes over about; with fewer, its start takes longer than its work.
TASK_BLOCKS = 12
#: Hash buckets of the features.
BUCKETS = 1 << 18
#: One host in so many is held out for validation.
HELD_OUT = 5
#: Share of a piece's rows that are error pages, from which it is an error message on the others too.
ERROR_SHARE = 0.2
#: Rows up to which a piece of 2xx pages may be left out of training as a doubtful example of real content.
RARE = 2
#: Most that a piece counts in training, however often it occurs (the root of its copies).
HEAVIEST = 12.0
#: Score (log-odds) from which a piece is residue.
CUT = 0.0
#: A fit ends when no slope of the mean loss is above this, or after so many steps.
SLOPE, STEPS = 1e-5, 200
#: Steps that the minimiser remembers.
MEMORY = 10
#: Terms of sums over pieces are rounded to this, so that the sums are exact and the same in any order.
GRAIN = 2.0**-24

# ---- pieces ----

_SITE_NAME = re.compile(r"\s+[|–—-]\s+[^\s|–—-]+(?:\s[^\s|–—-]+)?\s*$")
_SENTENCE = r"(?<=[.!?])\s+(?=\S)|\n+"


_EDGES = r"(?U)^\s+|\s+$"


def pieces(pages: DataFrame, *keep: Column) -> DataFrame:
    """``keep, text, is_title, a, b``: the title and each sentence of the body, blank ones left out; ``a`` and ``b`` are a 128-bit id of the piece."""
    title = F.array(F.struct(F.regexp_replace("title", _EDGES, "").alias("text"), F.lit(True).alias("is_title")))
    body = F.transform(F.split(F.coalesce("body_text", F.lit("")), rf"(?U){_SENTENCE}"), lambda s: F.struct(F.regexp_replace(s, _EDGES, "").alias("text"), F.lit(False).alias("is_title")))
    # explode_outer, as explode would have the list computed once more to tell whether it is empty
    each = pages.select(*keep, F.explode_outer(F.concat(title, body)).alias("p")).filter("p.text <> ''").select(*(c for c in pages.select(*keep).columns), "p.text", "p.is_title")
    return each.select("*", F.xxhash64("text", "is_title").alias("a"), F.xxhash64("is_title", F.lit("piece"), "text").alias("b"))


KIND_SCHEMA = "text string, is_title boolean, held boolean, n_ok long, n_bad long, form long, said int, ids array<int>"


def piece_table(pages: DataFrame) -> DataFrame:
    """KIND_SCHEMA: the different pieces, on how many 2xx rows and on how many of status 400 and over each is, by whether
    their host is held out; with the hash of its form, what its phrases say (phrase_label) and its features.

    Pieces are counted before they are shuffled, read once, however often they recur, and written by column: training and scoring take the features from there.
    """
    held = F.pmod(F.xxhash64(key_host(page_key(F.col("url")))), F.lit(HELD_OUT)) == 0
    ok, bad = F.col("status_code").between(200, 299), F.col("status_code") >= 400
    rows = pieces(pages.filter(ok | bad), held.alias("held"), ok.alias("ok"))
    kinds = rows.groupBy("text", "is_title", "held").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_bad"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms, ids = [], []
            for text, is_title in zip(b["text"], b["is_title"], strict=True):
                plain, slots = form(text, is_title)
                forms.append(xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - 2**63)
                ids.append(_features(plain, slots, is_title))
            yield b.assign(form=forms, said=pd.array([phrase_label(t) for t in b["text"]], dtype="Int32"), ids=ids)

    return cut_table(kinds.mapInPandas(look, KIND_SCHEMA))


def without_site_name(title: str) -> str:
    """A title without the site's name at its end, unless nothing else would be left or both halves are alike."""
    m = _SITE_NAME.search(title)
    if not m or not title[: m.start()].strip():
        return title
    return title[: m.start()].strip()


# ---- features ----

_TOKEN = re.compile(r"&#\d+;|[^\W_]*\d[^\W_]*|[^\W\d_]+|[{}\[\]<>%$#@_]{2,}|[^\w\s]|_")
_SLOT = re.compile(
    r"\{\{.*?\}\}|&#123;&#123;.*?&#125;&#125;|\{%.*?%\}|<%.*?%>|\$\{[^}]*\}|\[\[[^\]]*\]\]|%%\w[\w. -]*%%|@@\w[\w. -]*@@|__[A-Z][A-Z_.]*__|#[A-Z][A-Z_.]*#|"
    r"\{[a-z][a-z0-9]*[_.]?[a-z0-9_.]*\}|<[A-Z][A-Z0-9_-]*>|\[(?:insert|your) [^\]]*\]|\bINSERT [A-Z][A-Z_. ]* HERE\b|\[object Object\]|(?<!is )(?<!are )\bundefined\b(?! behaviou?r)",
    re.S | re.I,
)
_MAYBE = re.compile(r"[{%<\[@#$]|__|undefined|insert", re.I)
_QUOTED = re.compile(r"[\"“„«][^\"”“»]{3,60}[\"”“»]")


#: Words whose hashes a process remembers at most.
REMEMBERED = 200_000
_WORD_HASH: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _WORD_HASH.get(word)
    if h is None:
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(_WORD_HASH) < REMEMBERED:
            _WORD_HASH[word] = h
    return h


def _mixed(a: int, b: int) -> int:
    h = (a * 0x9E3779B1 + b * 0x85EBCA6B + 0x27D4EB2F) & 0xFFFFFFFF
    return h ^ (h >> 15)


def _slots(text: str) -> int:
    """How many placeholders a text has; most texts are told to have none by their characters."""
    return len(_SLOT.findall(text)) if _MAYBE.search(text) else 0


def form(text: str, is_title: bool) -> tuple[str, int]:
    """What of a piece is looked at, and how many placeholders it has: its words in lower case, words with digits as one, placeholders of any syntax as
    one, a title without the site's name. So what is learned from one spelling holds for the others.
    """
    t = without_site_name(text) if is_title else text
    slots = _slots(t)
    plain = _SLOT.sub(" ⟦slot⟧ ", t) if slots else html.unescape(t) if "&" in t else t
    if slots == 0 and plain is not t and _MAYBE.search(plain):
        plain = _SLOT.sub(" ⟦slot⟧ ", plain)
    plain = _QUOTED.sub(lambda m: " ⟦quote⟧ " + m.group(), plain)
    return " ".join("0" if any(c.isdigit() for c in w) else w.lower() for w in _TOKEN.findall(plain)), slots


def features(text: str, is_title: bool) -> list[int]:
    """Hashed features of a piece: 1- to 3-grams of its form with its ends marked, its length, and its shape."""
    return _features(*form(text, is_title), is_title)


def _features(plain: str, slots: int, is_title: bool) -> list[int]:
    words = plain.split()
    seq = [_hash(w) for w in ("^", *words, "$")]
    grams = set(seq)
    two = [_mixed(a, b) for a, b in zip(seq, seq[1:], strict=False)]
    grams.update(two)
    grams.update(_mixed(a, b) for a, b in zip(two, seq[2:], strict=False))
    kind = "t" if is_title else "b"
    n = len(words)
    extra = [f"len{kind}:{min(n, 40).bit_length()}", f"short{kind}:{n <= 4}", f"slots:{min(slots, 3)}", f"kind:{kind}"]
    if slots:
        extra.append(f"slotshare:{min(9, 10 * slots // max(1, n // 3))}")
    return sorted({g % BUCKETS for g in grams} | {_hash("x:" + e) % BUCKETS for e in extra})


# ---- weak labels ----

#: The words of the usual filler passage.
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum".split()
) - set("sit do ut et in non qui id est".split())
#: Names of filler text, and what stands where text is still to be written.
_FILL_TEXT = re.compile(
    r"\b(?:blindtext|platzhaltertext|dummy text|sample (?:text|copy)|placeholder text|texto de (?:relleno|ejemplo)|faux texte)\b|\b(?:text|copy|title|headline|heading|content|name|words) goes here\b|"
    r"\bhier (?:steht|kommt|folgt) (?:später|bald|noch)\b|\breplace this (?:text|paragraph|line|heading)\b",
    re.I,
)
#: Most words of a piece that such a name or a placeholder leaves no doubt in; least words to a placeholder among which it is an example.
FEW_WORDS, MANY_WORDS = 9, 15
#: What browsers call scripts. A demand ends there, or says where or what for.
_JS = r"(?:javascript|js|scripting|client-side scripts|scripts?)"
_SCRIPT_WORDS = {"javascript", "js", "scripting", "script", "scripts"}
_SCRIPTS = re.compile(
    rf"\b(?:enable|activate|allow|run|turn on|switch on|needs?|requires?|without|blocks|no)\b(?: \w+){{0,2}}? {_JS}\b(?=\W*$|[.,;:!–-]| (?:and|or|to|in your browser|you|support|turned on|so)\b)|"
    rf"\b(?:aktivieren sie|activ[ae]r?) {_JS}\b|"
    rf"\b{_JS}\b (?:is|are|must be|needs? to be) (?:\w+ )?(?:off|on|disabled|required|needed|active|activated|enabled|allowed|blocked)\b(?=\W*$|[.,;:!–-]| (?:to|in|for|and)\b)|\b{_JS} (?:turned (?:on|off)|support|required)(?=\W*$|[.,;:!])",
    re.I,
)
#: Nouns that name a sign. A placeholder or quotation before one is written about.
_NAMED = re.compile(r"⟦(?:slot|quote)⟧\W*(?:placeholder|tag|variable|token|notice|message|warning|banner)s?\b", re.I)


def filler_share(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in FILLER for w in words) / len(words) if words else 0.0


def written_about(text: str) -> bool:
    """Whether the piece names a sign rather than shows it, by its grammar: the placeholder or phrase is quoted among other words, or stands before a noun that names it."""
    marked = _SLOT.sub(" ⟦slot⟧ ", _QUOTED.sub(lambda m: m.group() if _SLOT.search(m.group()) else " ⟦quote⟧ ", text))
    return bool(_NAMED.search(marked)) or mentions_only(text, False)


def phrase_label(text: str) -> int | None:
    """What the phrases of a piece of a 2xx page say: 1 residue, 0 real content, None undecided.

    A piece that is mostly filler words or one word over and over, has a placeholder or a name of filler among few other words, or demands
    scripts is residue, unless its grammar tells that it is written about. A placeholder among some words is undecided, among many it is an
    example; undecided is also a piece that names the browser. Any other is real content.
    """
    slot = _slots(text)
    words = re.findall(r"[^\W\d_]+", (_SLOT.sub(" ", text) if slot else text).lower())
    if sum(w in FILLER for w in words) > 0.6 * len(words) or len(words) >= 3 and len(set(words)) == 1:
        return 1
    demand = not _SCRIPT_WORDS.isdisjoint(words) and bool(_SCRIPTS.search(text))
    if slot or demand or _FILL_TEXT.search(text):
        if written_about(text) or slot and len(words) >= MANY_WORDS * slot:
            return 0
        return 1 if demand or len(words) <= FEW_WORDS else None
    return None if "browser" in text.lower() else 0


# ---- the classifier ----


@dataclass
class Model:
    """Weights of the hashed features and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, ids: list[int]) -> float:
        return float(self.weights[ids].sum() + self.bias)


def labelled(kinds: DataFrame, held_out: bool | None) -> DataFrame:
    """``is_title, ids, n, y``: every weakly labelled piece of the training hosts, of the held-out ones, or, for None, of all.

    Pieces of one form are one. What pages of status 400 and over say is an error message, on those pages and, if they make up ERROR_SHARE of its rows, on
    any; else phrases tell (phrase_label).
    """
    each = kinds if held_out is None else kinds.filter("held" if held_out else "NOT held")
    known = F.when(F.col("said").isNotNull(), F.col("n_ok"))
    ok, bad = F.col("ok"), F.col("bad")
    per = each.groupBy("form", "is_title").agg(F.min("ids").alias("ids"), F.sum("n_ok").alias("all_ok"), F.sum("n_bad").alias("bad"), F.coalesce(F.sum(known), F.lit(0)).alias("ok"), F.coalesce(F.sum(known * F.col("said")), F.lit(0)).alias("yes"))
    error = (bad > 0) & (bad >= ERROR_SHARE * (bad + F.col("all_ok")))
    told = per.select("is_title", "ids", F.when(error, bad + F.col("yes")).otherwise(bad + ok).alias("n"), F.when(error, 1.0).otherwise((bad + F.col("yes")) / F.greatest(bad + ok, F.lit(1))).alias("y"))
    return told.filter("n > 0")


BLOCK_SCHEMA = "sizes binary, ids binary, y binary, w binary, half binary"
_BLOCK_TYPES = {"sizes": np.int32, "ids": np.int32, "y": np.float64, "w": np.float64, "half": np.int8}


def _pack(**columns: np.ndarray) -> dict[str, bytes]:
    return {k: np.asarray(columns[k], dtype=t).tobytes() for k, t in _BLOCK_TYPES.items()}


def _unpack(row: Row) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(row[k], dtype=t) for k, t in _BLOCK_TYPES.items()}


def blocks(pieces: DataFrame, most: int = BLOCK) -> DataFrame:
    """BLOCK_SCHEMA: ``labelled`` pieces, at most ``most`` a row, written once to be gone over often: the number of features of each, all their features, labels, weights in training and halves."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), most):
                p = b.iloc[at : at + most]
                rows = [np.asarray(x, dtype=np.int32) for x in p["ids"]]
                half = [zlib.crc32(r.tobytes()) % 2 for r in rows]
                yield pd.DataFrame([_pack(sizes=[len(r) for r in rows], ids=np.concatenate(rows), y=p["y"], w=np.minimum(np.sqrt(p["n"]), HEAVIEST), half=half)])

    packed = cut(pieces.mapInPandas(pack, BLOCK_SCHEMA))
    return packed.coalesce(max(1, -(-packed.count() // TASK_BLOCKS)))


def _sum(packed: DataFrame, values: object, look: Callable[..., np.ndarray]) -> np.ndarray | None:
    """The sum of ``look(values, **block)`` over all blocks, added up where they lie and then by a tree of fan-in 16. None without blocks."""
    shared = packed.sparkSession.sparkContext.broadcast(values)

    def add(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return b if a is None else a if b is None else a + b

    try:
        rows = packed.rdd
        depth = max(1, math.ceil(math.log(max(1, rows.getNumPartitions()), 16)))
        return rows.treeAggregate(None, lambda a, r: add(a, look(shared.value, **_unpack(r))), add, depth)
    finally:
        shared.destroy()


def _grains(x: np.ndarray) -> np.ndarray:
    return np.round(x / GRAIN) * GRAIN


def _scores(weights: np.ndarray, bias: np.ndarray | float, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[ids], np.cumsum([0, *sizes[:-1]])) + bias  # no piece is without features


def _slope(model: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The loss of a block's pieces and its gradient by ``model``: a row of weights and a bias for each model, how often each counts residue, and the buckets that the weights are of. Of two models, each has the pieces of the other's half."""
    values, often, used = model
    models = len(values)
    flat = np.zeros((models, BUCKETS))
    flat[:, used] = values[:, :-1]
    flat = flat.ravel()
    mine = 1 - half.astype(np.int64) if models == 2 else np.zeros(len(half), dtype=np.int64)
    w = np.where(y >= 0.5, often[mine], 1.0) * w
    at = ids + np.repeat(mine * BUCKETS, sizes)
    z = _scores(flat, values[mine, -1], at, sizes)
    g = _grains((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w)
    slope = np.bincount(at, weights=np.repeat(g, sizes), minlength=flat.size).reshape(models, BUCKETS)[:, used]
    slope = np.column_stack([slope, np.bincount(mine, weights=g, minlength=models)])
    return np.append(_grains(w * (np.logaddexp(0, z) - y * z)).sum(), slope)


def _counts(models: int, sizes: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray, half: np.ndarray) -> np.ndarray:
    """For each model of ``_slope``: its pieces, the weight of those labelled residue, and of the others."""
    mine = [half != k if models == 2 else half >= 0 for k in range(models)]
    return np.array([[k.sum(), _grains(w[k & (y >= 0.5)]).sum(), _grains(w[k & (y < 0.5)]).sum()] for k in mine])


def _used(_: None, ids: np.ndarray, **other: np.ndarray) -> np.ndarray:
    """Which buckets a block's pieces have; of two blocks, the sum is what either has."""
    return np.bincount(ids, minlength=BUCKETS) > 0


def fit(packed: DataFrame, models: int = 1, start: np.ndarray | None = None, l2: float = 5e-5) -> np.ndarray:
    """Logistic regression with an L2 penalty on all pieces of ``packed`` (blocks): a row of weights, and the bias at its end, for each model.

    One model has all pieces; of two, fitted together, each has those of one half. Residue is rare: its pieces are weighted to count as much as all others together. The convex loss is minimised by L-BFGS, each step of
    which goes over all pieces where they lie; the driver holds weights and slopes only. The same pieces give the same model, however they are
    spread over partitions and blocks. Without any piece, or any residue, a model flags nothing.
    """
    whole = np.zeros((models, BUCKETS + 1))
    counts = _sum(packed, models, _counts)
    if counts is None or counts[:, 1].sum() == 0:
        whole[:, -1] = -1.0
        return whole
    used = np.append(np.flatnonzero(_sum(packed, None, _used)), BUCKETS)
    n, yes, no = counts[:, :1], counts[:, 1], counts[:, 2]
    often = np.where((yes > 0) & (no > yes), no / np.maximum(yes, 1), 1.0)
    penalty = np.tile((used < BUCKETS) * l2, (models, 1)) * n

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = _sum(packed, (x, often, used[:-1]), _slope)
        return float(got[0] + (penalty * x * x).sum() / 2), got[1:].reshape(x.shape) + penalty * x

    x = (whole if start is None else start)[:, used]
    x[yes == 0, -1] = -1.0
    f, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        if (np.abs(g) <= SLOPE * np.maximum(n, 1)).all():
            break
        way, parts = g.copy(), []
        for s, t, st in reversed(steps):
            parts.append((s * way).sum() / st)
            way -= parts[-1] * t
        way *= steps[-1][2] / (steps[-1][1] ** 2).sum() if steps else 1 / np.abs(g).sum()
        for (s, t, st), u in zip(steps, reversed(parts), strict=True):
            way += s * (u - (t * way).sum() / st)
        fall, length = (g * way).sum(), 1.0
        while True:
            to = x - length * way
            f_to, g_to = loss(to)
            if f_to <= f - 1e-4 * length * fall or length < 1e-6:
                break
            length /= 2
        if f_to > f:  # no better within the grain of the sums
            break
        s, t = to - x, g_to - g
        if (s * t).sum() > 0:
            steps = [*steps, (s, t, (s * t).sum())][-MEMORY:]
        x, f, g = to, f_to, g_to
    whole[:, used] = x
    return whole


def train(kinds: DataFrame, most: int = BLOCK, every_host: bool = False) -> Model:
    """The classifier fitted on every weakly labelled piece of ``kinds`` (piece_table), at most ``most`` at a time. Without any piece, one that flags nothing.

    The held-out hosts are left to ``validate``; with ``every_host``, as queries use it, nothing is held out.
    """
    packed = blocks(labelled(kinds, None if every_host else False), most)
    halves = fit(packed, models=2)
    if not halves[:, :-1].any():
        return Model(halves[0, :-1], -1.0)
    x = fit(trusted(packed, halves), start=halves.mean(axis=0, keepdims=True))
    return Model(x[0, :-1], float(x[0, -1]))


def trusted(packed: DataFrame, halves: np.ndarray) -> DataFrame:
    """The pieces whose label is believed. Error messages also stand on pages of status 200, where nothing but that status calls them
    real content: such a piece is left out if it occurs hardly twice and a classifier fitted on the other half (``halves``) takes it for residue.
    """
    shared = packed.sparkSession.sparkContext.broadcast(halves)

    def look(rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            b = _unpack(r)
            z = np.where(b["half"] == 0, *(_scores(m[:-1], m[-1], b["ids"], b["sizes"]) for m in shared.value))
            keep = ~((z >= CUT) & (b["y"] < 0.5) & (b["w"] ** 2 <= RARE + 1e-9))
            if keep.any():
                kept = {k: b[k][keep] for k in b if k != "ids"}
                yield tuple(_pack(ids=b["ids"][np.repeat(keep, b["sizes"])], **kept).values())

    kept = cut(packed.sparkSession.createDataFrame(packed.rdd.mapPartitions(look), BLOCK_SCHEMA))
    shared.destroy()
    return kept


def validate(kinds: DataFrame, model: Model, most: int = BLOCK) -> dict[str, float]:
    """Precision, recall and accuracy on every weakly labelled piece of hosts the classifier has not seen, at most ``most`` at a time."""

    def look(values: np.ndarray, sizes: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray, half: np.ndarray) -> np.ndarray:
        p, t = _scores(values[:-1], values[-1], ids, sizes) >= CUT, y >= 0.5
        return np.array([len(y), p.sum(), t.sum(), (p & t).sum(), (p == t).sum()])

    got = _sum(blocks(labelled(kinds, True), most), np.append(model.weights, model.bias), look)
    n, p, t, both, same = (0, 0, 0, 0, 0) if got is None else got.tolist()
    return {"pieces": float(n), "precision": both / max(1, p), "recall": both / max(1, t), "accuracy": same / n if n else 1.0}


def mentions_only(text: str, is_title: bool) -> bool:
    """Exact check after the classifier: a placeholder or a phrase inside quotes, with enough other words around it, is written about, not shown."""
    t = without_site_name(text) if is_title else text
    rest = _QUOTED.sub(" ", t)
    return rest != t and len(re.findall(r"[^\W\d_]+", rest)) >= 2 and not _SLOT.search(rest)


def flagged(pages: DataFrame, kinds: DataFrame, model: Model) -> DataFrame:
    """``page_id, piece, score`` of 2xx rows of which a piece is residue: the piece with the highest score.

    Each different piece (``kinds`` is piece_table of the pages) is scored once; the few that are residue are joined back to the rows by their ids. Rows
    with neither a title nor text, and rows of unknown status or without an id, are not flagged.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        for b in batches:
            n = [len(x) for x in b["ids"]]  # no piece is without features
            score = np.add.reduceat(weights[np.concatenate(b["ids"].to_list())], np.cumsum([0, *n[:-1]])) + bias if len(b) else np.zeros(0)
            best = b.assign(score=score)[score >= CUT]
            shown = [not mentions_only(t, k) for t, k in zip(best["text"], best["is_title"], strict=True)]
            yield best[np.array(shown, dtype=bool)][["text", "is_title", "score"]]

    good = pages.filter("status_code BETWEEN 200 AND 299 AND page_id IS NOT NULL")
    shown = kinds.filter("n_ok > 0").select("text", "is_title", "ids").mapInPandas(look, "text string, is_title boolean, score double")
    shown = shown.dropDuplicates(["text", "is_title"])  # of held-out and other hosts
    ids = cut(shown.select(F.xxhash64("text", "is_title").alias("a"), F.xxhash64("is_title", F.lit("piece"), "text").alias("b"), "score", F.col("text").alias("piece")))
    hit = lookup_join(pieces(good, F.col("page_id")).select("page_id", "a", "b"), ids, ["a", "b"])
    return hit.groupBy("page_id").agg(F.max(F.struct("score", "piece")).alias("m")).select("page_id", "m.piece", "m.score")


def residue_pages(pages: DataFrame) -> DataFrame:
    """``page_id, piece, score``: flagged by a classifier fitted on all hosts of the pages."""
    kinds = piece_table(pages)
    return flagged(pages, kinds, train(kinds, every_host=True))
