"""Subject areas of each document (problem 10).

Every sentence is voted on by labelling functions: a fixed seed lexicon, a lexicon learned from hand
labels and grown over the whole corpus, the section around the sentence, the site's address, and the
source. A latent model learns how far each may be trusted, without labels, from the pattern of their
votes over all sentences; documents get the subjects that enough of their sentences are about.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.mixing import source_name
from seamark.plans.skew import lookup_join
from seamark.session import cut, cut_table, spread

#: Share of a document's sentences from which it is about a subject.
SHARE = 0.25
#: Most terms of a learned lexicon that is broadcast; a larger one stays a table that each document's terms are joined to.
BROADCAST_TERMS = 200_000
#: Most subjects; the table of subjects is gathered after it was counted.
MAX_SUBJECTS = 60
#: Rounds in which the lexicon is grown over the corpus.
ROUNDS = 3
#: Hand-labelled documents that the first lexicon is learned from at most.
MAX_LABELLED = 50_000

#: Seed words of the subjects, in English, German and Spanish.
SEEDS = {
    "science": "experiment hypothesis telescope enzyme isotope spectrometer laboratory galaxy molecules hypothese experiment messreihe enzym komet hipótesis experimento teoría enzima cometa",
    "law": "court judge contract statute defendant tribunal lawsuit injunction gericht klägerin vertrag richter urteil tribunal juez demandante cláusula contrato sentencia",
    "sport": "goalkeeper referee match league sprinter coach tournament torwart mannschaft schiedsrichter trainer liga portero árbitro equipo entrenador delantero",
    "software": "compiler parser python deploy debug scheduler library code quelltext programm bibliothek schnittstelle compilador código biblioteca programa servidor",
    "finance": "bank dividend bond mortgage pension equities currency interest anleihe zentralbank hypothek zinsen leitzins banco hipoteca bono dividendo inflación",
    "health": "patient clinic vaccine nurse symptom medicine doctor allergy patientin impfstoff fieber allergie arzt paciente vacuna fiebre alergia enfermera",
    "food": "oven sauce soup dough recipe bake simmer butter teig suppe braten zwiebel soße masa caldo cebolla queso horno",
    "travel": "hotel ferry itinerary guesthouse campsite luggage passport fähre reise wanderung insel hotel albergue transbordador viajeros sendero tren",
    "gardening": "compost mulch seedling greenhouse hedge pruning lawn beet kompost hecke rasen gießen abono huerto seto césped poda",
    "web_marketing": "sitemap backlink canonical campaign newsletter clicks impressions suchmaschine kampagne weiterleitung suchergebnis rastreo buscador campaña boletín redirección",
}

# ---- sentences and terms ----

_TAG = re.compile(r"<[^<>]{1,200}>")
_END = re.compile(r"(?<=[.!?…])[\"”“»)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+")
_ENDED = re.compile(r"[.!?…][\"”“»)\]]*$")


def sections(text: str | None) -> list[list[list[str]]]:
    """Sections (blocks between blank lines) of sentences of lower-case words. Markup is dropped; lines that
    end without punctuation (menus, headings) are no sentences, unless the text has no other."""
    plain = text or ""
    if "<" in plain:
        plain = _TAG.sub(" ", plain)
    if "&" in plain:
        plain = html.unescape(plain)
    out, bare = [], []
    for block in re.split(r"\n\s*\n", plain):
        own = []
        for line in block.split("\n"):
            for s in _END.split(line.strip()):
                words = _WORD.findall(s.lower())
                if words:
                    (own if _ENDED.search(s.strip()) else bare).append(words)
        if own:
            out.append(own)
    return out or ([bare] if bare else [])


#: Most words whose hashes a worker remembers; the rest are hashed anew.
REMEMBERED = 1_000_000
#: Words that are worked on at once.
CHUNK = 2_000_000
_TOKEN_SCHEMA = "doc_id string, site string, source string, words array<long>, lens array<int>, blocks array<int>, first array<boolean>"
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
#: The term that stands for a document or sentence as a whole.
WHOLE = 0


def word_id(word: str) -> int:
    """64-bit id of a word, as a signed number."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - 2**63


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit ids of pairs of neighbouring words."""
    h = (a.view(np.uint64) * _P + b.view(np.uint64)) * _Q
    return (h ^ (h >> _R)).view(np.int64)


def tokenised(docs: DataFrame) -> DataFrame:
    """_TOKEN_SCHEMA of each document, read once and written by column: ids of its words, words of each sentence, sentences of
    each section, and which sentences are the first of their wording in the document. All that follows works on these numbers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            words, lens, blocks, first = [], [], [], []
            for text in b["text"]:
                w, n, k, f, seen = [], [], [], [], set()
                for block in sections(text):
                    k.append(len(block))
                    for s in block:
                        for x in s:
                            h = known.get(x)
                            if h is None:
                                h = word_id(x)
                                if len(known) < REMEMBERED:
                                    known[x] = h
                            w.append(h)
                        n.append(len(s))
                        t = tuple(s)
                        f.append(t not in seen)
                        seen.add(t)
                words.append(w)
                lens.append(n)
                blocks.append(k)
                first.append(f)
            yield pd.DataFrame({"doc_id": b["doc_id"], "site": b["site"], "source": b["source"], "words": words, "lens": lens, "blocks": blocks, "first": first})

    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.trim("site")).alias("site"), source_name(F.col("source")).alias("source"), "text")
    return cut_table(spread(src).mapInPandas(read, _TOKEN_SCHEMA))


class Chunk:
    """Some documents, flat: ``words`` and their ``sentence``; of each sentence its ``doc``, ``block`` and whether it is the ``first`` of its wording."""

    def __init__(self, b: pd.DataFrame):
        self.rows, self.docs = b, len(b)
        join = lambda c, t: np.concatenate([np.asarray(x, dtype=t) for x in b[c]]) if len(b) else np.zeros(0, t)
        self.words, lens, blocks = join("words", np.int64), join("lens", np.int64), join("blocks", np.int64)
        self.first = join("first", bool)
        self.sentences = len(lens)
        self.sentence = np.repeat(np.arange(self.sentences), lens)
        self.per_doc = np.array([len(x) for x in b["lens"]], dtype=np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.per_doc)
        self.block = np.repeat(np.arange(len(blocks)), blocks)
        self.block_size = np.repeat(blocks, blocks)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """``(sentence, term)`` of all words and pairs of neighbouring words; terms recur."""
        near = self.sentence[1:] == self.sentence[:-1]
        pairs = pair_ids(self.words[:-1][near], self.words[1:][near])
        return np.concatenate([self.sentence, self.sentence[1:][near]]), np.concatenate([self.words, pairs])

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        """Values by sentence as one array a document."""
        return np.split(values, np.cumsum(self.per_doc)[:-1]) if self.docs else []


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    """Documents in pieces of about CHUNK words; a longer document is one by itself."""
    for b in batches:
        size = np.cumsum([len(x) for x in b["words"]]) // CHUNK
        for _, part in b.groupby(size, sort=True):
            yield Chunk(part)


def distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the first of each pair of numbers; pairs are told apart by 64 bits of both."""
    h = (a.view(np.uint64) * _Q) ^ (b.view(np.uint64) * _P + (b.view(np.uint64) >> _R))
    return np.flatnonzero(~pd.Series(h).duplicated().to_numpy())


#: A lexicon that is broadcast: terms in order, the subject of each, its weight.
Lexicon = tuple[np.ndarray, np.ndarray, np.ndarray]


def lexicon_of(rows: list[tuple[int, int, float]]) -> Lexicon:
    rows = sorted(rows)
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=float)


def looked_up(found: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the terms found that the lexicon has, and their places in it."""
    known = lexicon[0]
    if not len(known) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # most terms are told from the lexicon's by a few bits
    bits = np.zeros(1 << 20, dtype=bool)
    bits[known & ((1 << 20) - 1)] = True
    maybe = np.flatnonzero(bits[found & ((1 << 20) - 1)])
    at = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
    hit = known[at] == found[maybe]
    return maybe[hit], at[hit]


#: Weight that a vote takes: of one clear term while the lexicon is small, of two once it has grown.
ONE_TERM, TWO_TERMS = 1.5, 7.5


def votes(sentences: int, sentence: np.ndarray, found: np.ndarray, lexicon: Lexicon, base: int, least: float, margin: float = 1.0) -> np.ndarray:
    """Of each sentence the number of the subject (from 1) that its different terms speak for, 0 if they don't speak clearly."""
    at, place = looked_up(found, lexicon)
    own = distinct(sentence[at], found[at])
    at, place = at[own], place[own]
    score = np.bincount(sentence[at] * base + lexicon[1][place], weights=lexicon[2][place], minlength=sentences * base).reshape(sentences, base)
    best = score.argmax(axis=1)
    top = score[np.arange(sentences), best]
    score[np.arange(sentences), best] = 0.0
    return np.where((top >= least) & (top - score.max(axis=1, initial=0.0) >= margin), best, 0)


# ---- lexicons ----


def seed_lexicon(subjects: list[str], descriptions: list[str]) -> Lexicon:
    """Seed words, and the words of the subjects' descriptions, each with the one subject that has it."""
    owners: dict[str, set[int]] = {}
    for i, (s, d) in enumerate(zip(subjects, descriptions, strict=True), 1):
        for w in {*SEEDS.get(s, "").split(), *(w for w in _WORD.findall((d or "").lower()) if len(w) > 4), *_WORD.findall(s.lower().replace("_", " "))}:
            owners.setdefault(w, set()).add(i)
    return lexicon_of([(word_id(w), min(o), 2.0) for w, o in owners.items() if len(o) == 1])


_COUNTS = "term long, subject int, n double"


def _counted(term: np.ndarray, subject: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """_COUNTS of one chunk, added up."""
    return pd.DataFrame({"term": term, "subject": subject.astype(np.int32), "n": n.astype(float)}).groupby(["term", "subject"], as_index=False, sort=False)["n"].sum()


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term", "subject").agg(F.sum("n").alias("n"))


def labelled_counts(texts: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """_COUNTS: in how many hand-labelled documents of a subject each term is, 0 standing for none. ``texts`` is tokenised's result.

    A document's label counts in proportion to the hand labels it has; labels of other names than the subjects' and ``none`` are left out.
    """
    number = F.create_map(*(x for i, s in enumerate(["none", *subjects]) for x in (F.lit(s), F.lit(i))))
    given = labels.select(F.col("doc_id").cast("string").alias("doc_id"), number[F.lower(F.trim("subject"))].alias("k")).filter("k IS NOT NULL AND doc_id IS NOT NULL")
    per = cut(given.groupBy("doc_id").agg(F.collect_list("k").alias("ks")).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED))
    rows = lookup_join(texts, per, ["doc_id"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches):
            sentence, term = c.terms()
            doc = np.concatenate([c.doc[sentence], np.arange(c.docs)])
            term = np.concatenate([term, np.full(c.docs, WHOLE)])
            own = distinct(doc, term)
            doc, term = doc[own], term[own]
            ks = [np.asarray(x, dtype=np.int64) for x in c.rows["ks"]]
            size = np.array([len(x) for x in ks], dtype=np.int64)
            start = np.cumsum(size) - size
            times = size[doc]
            at = np.repeat(start[doc], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield _counted(np.repeat(term, times), np.concatenate(ks)[at] if len(ks) else at, np.repeat(1 / times, times))

    return _summed(rows.mapInPandas(count, _COUNTS))


def with_lexicon(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``texts`` with ``lex_term, lex_subject, lex_weight``: the part of the lexicon (``term, subject, weight``) that each text needs, null if none."""
    rows = cut(texts.withColumn("_row", F.monotonically_increasing_id()))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches):
            sentence, term = c.terms()
            doc = c.doc[sentence]
            mine = distinct(doc, term)
            yield pd.DataFrame({"_row": c.rows["_row"].to_numpy()[doc[mine]], "term": term[mine]})

    hits = lookup_join(rows.mapInPandas(own, "_row long, term long"), lexicon, ["term"])
    per = hits.groupBy("_row").agg(F.collect_list(F.struct("term", "subject", "weight")).alias("lex"))
    return rows.join(per.select("_row", *(F.col(f"lex.{n}").alias(f"lex_{n}") for n in ("term", "subject", "weight"))), "_row", "left").drop("_row")


def _own_lexicon(c: Chunk) -> Lexicon:
    """Of a chunk of with_lexicon, the part that its texts need."""
    some = c.rows[c.rows["lex_term"].notna()]
    if some.empty:
        return lexicon_of([])
    term, subject, weight = (np.concatenate([np.asarray(x, dtype=t) for x in some[n]]) for n, t in (("lex_term", np.int64), ("lex_subject", np.int64), ("lex_weight", float)))
    term, at = np.unique(term, return_index=True)
    return term, subject[at], weight[at]


def voted_counts(texts: DataFrame, lexicon: Lexicon | DataFrame, least: float, base: int) -> DataFrame:
    """_COUNTS: in how many sentences voted for a subject (0: for none) each term is, over the whole corpus.

    A vote counts if at least a fifth of the document's other sentences have it too, else as one for none: so
    fixed phrases that occur in documents of any subject are learned as such. A document's equal sentences
    count once, and sentences that stand alone not at all, as nothing can back them.
    """
    small = isinstance(lexicon, tuple)
    src = texts if small else with_lexicon(texts, lexicon)
    shared = texts.sparkSession.sparkContext.broadcast(lexicon if small else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches):
            sentence, term = c.terms()
            vote = votes(c.sentences, sentence, term, shared.value if small else _own_lexicon(c), base, least)
            different = np.bincount(c.doc[c.first], minlength=c.docs)
            total = np.bincount(c.doc[c.first] * base + vote[c.first], minlength=c.docs * base)
            backed = 5 * (total[c.doc * base + vote] - 1) >= different[c.doc] - 1
            vote = np.where(backed, vote, 0)
            counts = c.first & (different[c.doc] >= 2)
            use = counts[sentence]
            sentence, term = np.concatenate([sentence[use], np.flatnonzero(counts)]), np.concatenate([term[use], np.full(counts.sum(), WHOLE)])
            own = distinct(sentence, term)
            yield _counted(term[own], vote[sentence[own]], np.ones(len(own)))

    return _summed(src.mapInPandas(count, _COUNTS))


def learned_lexicon(counts: DataFrame, least: float, share: float, none: bool = False, broadcast: int = BROADCAST_TERMS) -> Lexicon | DataFrame:
    """Terms that speak for one subject, with their log-odds: at least ``least`` occurrences, and ``share`` of them in
    that subject after the subjects' sizes are made equal. With ``none``, also terms that speak for no subject (0)
    in the same way. All of them: in arrays if they were counted to be at most ``broadcast``, else a table ``term, subject, weight``."""
    counts = cut(counts)
    sizes = {r["subject"]: r["n"] for r in counts.filter(F.col("term") == WHOLE).collect()}
    if not sizes:
        return lexicon_of([])
    size = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))))
    rate = (F.col("n") / size[F.col("subject")]).alias("rate")
    top = F.col("top")
    meant = (top["subject"] > 0) | F.lit(none)
    floor = 0.5 / max(1.0, sum(sizes.values()))
    rest = (F.col("all") - top["rate"]) / max(1, len(sizes) - 1)
    found = cut(
        counts.filter(F.col("term") != WHOLE).select("term", "subject", "n", rate).groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("rate").alias("all"), F.max(F.struct("rate", "subject")).alias("top"))
        .filter((F.col("n") >= least) & (top["rate"] >= share * F.col("all")) & meant)
        .select("term", top["subject"].alias("subject"), F.least(F.lit(5.0), F.log((top["rate"] + floor) / (rest + floor))).alias("weight"))
    )
    if found.count() > broadcast:
        return found
    return lexicon_of([(r["term"], r["subject"], r["weight"]) for r in found.collect()])


def with_seeds(lexicon: Lexicon | DataFrame, seeds: Lexicon) -> Lexicon | DataFrame:
    """The lexicon with the seed words in place of its own entries for them."""
    rows = list(zip(*(x.tolist() for x in seeds), strict=True))
    if isinstance(lexicon, tuple):
        return lexicon_of(list({r[0]: r for r in [*zip(*(x.tolist() for x in lexicon), strict=True), *rows]}.values()))
    own = lexicon.sparkSession.createDataFrame(rows, "term long, subject int, weight double")
    return cut(lexicon.join(F.broadcast(own), "term", "left_anti").unionByName(own))


# ---- the latent model ----


class LabelModel:
    """Votes of several labelling functions on a hidden class, each function with a table of how it votes on every
    class, learned by expectation-maximisation from counts of vote patterns alone.

    ``weights`` temper functions that are not independent given the class: those that read the same
    words, or that all reflect what the rest of the document is about, together count about once."""

    def __init__(self, classes: int, weights: tuple[float, ...]):
        self.classes, self.functions, self.weights = classes, len(weights), weights
        functions = self.functions
        self.prior = np.full(classes, 1 / classes)
        self.tables = np.full((functions, classes, classes), 1 / classes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of every class (columns) for each row of votes."""
        z = np.log(self.prior)[None, :] + sum(w * np.log(self.tables[j][:, votes[:, j]]).T for j, w in enumerate(self.weights))
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: int, rounds: int = 40, smooth: float = 1.0) -> LabelModel:
        """Begins with the votes of function ``start`` as nearly true."""
        n = self.classes
        p = np.full((len(votes), n), 0.1 / n)
        p[np.arange(len(votes)), votes[:, start]] += 0.9
        for _ in range(rounds):
            w = p * counts[:, None]
            self.prior = (w.sum(axis=0) + smooth) / (w.sum() + smooth * n)
            for j in range(self.functions):
                t = np.full((n, n), smooth / n)
                np.add.at(t.T, votes[:, j], w)
                self.tables[j] = t / t.sum(axis=1, keepdims=True)
            p = self.posterior(votes)
        return self

    def accuracies(self) -> np.ndarray:
        """Of each function, how often it votes for the class that holds, where it votes for a subject."""
        out = []
        for t in self.tables:
            hit, said = (self.prior[1:] * np.diag(t)[1:]).sum(), (self.prior[:, None] * t[:, 1:]).sum()
            out.append(hit / said if said else 0.0)
        return np.array(out)


#: Labelling functions, in the order of a pattern's digits.
FUNCTIONS = ("seeds", "lexicon", "section", "address", "source")
#: Their weights in the latent model.
WEIGHTS = (0.5, 1.0, 1 / 3, 1 / 3, 1 / 3)


def _around(c: Chunk, vote: np.ndarray, base: int) -> np.ndarray:
    """Of each sentence, the subject that most of the other sentences around it are voted for: those of its section, or of the document if the section has no other; 0 without a clear one."""
    said = vote > 0
    section = np.zeros((int(c.block.max(initial=-1)) + 1, base), dtype=np.int64)
    whole = np.zeros((c.docs, base), dtype=np.int64)
    np.add.at(section, (c.block[said], vote[said]), 1)
    np.add.at(whole, (c.doc[said], vote[said]), 1)
    near = np.where((c.block_size > 1)[:, None], section[c.block], whole[c.doc])
    near[np.flatnonzero(said), vote[said]] -= 1
    best = near.argmax(axis=1)
    top = near[np.arange(c.sentences), best]
    return np.where((top > 0) & ((near == top[:, None]).sum(axis=1) == 1), best, 0)


def sentence_votes(texts: DataFrame, seeds: Lexicon, lexicon: Lexicon | DataFrame, base: int) -> DataFrame:
    """``doc_id, site, source, codes, named``: per sentence the votes of seeds, lexicon and section as digits of one number to ``base``."""
    small = isinstance(lexicon, tuple)
    shared = texts.sparkSession.sparkContext.broadcast((seeds, lexicon if small else None))
    src = texts if small else with_lexicon(texts, lexicon)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, given = shared.value
        for c in chunks(batches):
            sentence, term = c.terms()
            a = votes(c.sentences, sentence, term, one, base, ONE_TERM)
            v = votes(c.sentences, sentence, term, given if small else _own_lexicon(c), base, TWO_TERMS)
            codes = c.split((a * base + v) * base + _around(c, v, base))
            texts = {n: c.rows[n].to_numpy(dtype=object) for n in ("doc_id", "site", "source")}
            yield pd.DataFrame({**texts, "codes": codes, "named": [x[x > 0] for x in c.split(v)]})

    return src.mapInPandas(look, "doc_id string, site string, source string, codes array<int>, named array<int>")


def leaning(votes: DataFrame, by: str, least: int = 20, share: float = 0.5) -> DataFrame:
    """``by, vote``: the subject that most voted sentences of a site or source are about, if at least ``share`` of them are."""
    counts = votes.filter(F.col(by).isNotNull()).select(by, F.explode("named").alias("k")).groupBy(by, "k").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.sum("n").alias("all"), F.max(F.struct("n", "k")).alias("top"))
    return best.filter((F.col("all") >= least) & (F.col("top.n") >= share * F.col("all"))).select(by, F.col("top.k").alias(f"{by}_vote"))


def assign(docs: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE, rounds: int = ROUNDS, broadcast: int = BROADCAST_TERMS) -> DataFrame:
    """``doc_id, subject, sentences, about``: the subjects that at least ``share`` of a document's sentences are about.

    Null, empty and wordless texts have no subject; documents without an id share a null one. Without hand labels, the seed words alone begin the
    lexicon; without subjects there are no rows.
    """
    rows = subjects.filter("subject IS NOT NULL").select("subject", "description").dropDuplicates(["subject"]).orderBy("subject").limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names, base = [r["subject"] for r in rows], len(rows) + 1
    out_schema = "doc_id string, subject string, sentences int, about int"
    if not names:
        return docs.sparkSession.createDataFrame([], out_schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    seeds = seed_lexicon(names, [r["description"] for r in rows])
    texts = tokenised(docs)
    lexicon = with_seeds(learned_lexicon(labelled_counts(texts, labels, [n.lower() for n in names]), least=6, share=0.75, broadcast=broadcast), seeds)
    for k in range(rounds):
        grown = learned_lexicon(voted_counts(texts, lexicon, TWO_TERMS if k else ONE_TERM, base), least=5, share=0.75, none=k == rounds - 1, broadcast=broadcast)
        lexicon = lexicon if isinstance(grown, tuple) and not len(grown[0]) else grown
    votes = cut(sentence_votes(texts, seeds, lexicon, base))
    for by in ("site", "source"):
        votes = lookup_join(votes, cut(leaning(votes, by)), [by], "left")
    zero = [F.coalesce(F.col(f"{by}_vote"), F.lit(0)) for by in ("site", "source")]
    coded = cut(votes.select("doc_id", F.transform("codes", lambda c: (c * base + zero[0]) * base + zero[1]).alias("codes")))
    # at most base ** 5 patterns, whatever the number of sentences
    seen = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    codes = np.array([r["code"] for r in seen], dtype=np.int64)
    digits = np.stack([codes // base**p % base for p in range(len(FUNCTIONS) - 1, -1, -1)], axis=1) if seen else np.zeros((0, len(FUNCTIONS)), dtype=np.int64)
    model = LabelModel(base, WEIGHTS).fit(digits, np.array([r["n"] for r in seen], dtype=float), FUNCTIONS.index("lexicon"))
    p = model.posterior(digits)
    best = {int(c): int(k) for c, k, top in zip(codes, p.argmax(axis=1), p.max(axis=1), strict=True) if k and top >= 0.5}
    told = sorted(best)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(told, dtype=np.int64), np.array([best[c] for c in told], dtype=np.int64)))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, subject = shared.value
        for b in batches:
            n = np.array([len(x) for x in b["codes"]], dtype=np.int64)
            code = np.concatenate([np.asarray(x, dtype=np.int64) for x in b["codes"]]) if len(b) else np.zeros(0, np.int64)
            k = np.zeros(len(code), dtype=np.int64)
            if len(known) and len(code):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                k = np.where(known[at] == code, subject[at], 0)
            about = np.bincount(np.repeat(np.arange(len(b)), n) * base + k, minlength=len(b) * base).reshape(len(b), base)
            doc, k = np.nonzero((about > 0) & (about >= share * n[:, None] - 1e-9) & (np.arange(base) > 0))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(dtype=object)[doc], "subject": np.array(names, dtype=object)[k - 1], "sentences": n[doc], "about": about[doc, k]})

    return coded.mapInPandas(decide, out_schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def corpus_shares(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """``subject, docs, share``: how many documents are about each subject, and about none."""
    total = docs.count()
    some = assigned.select("doc_id").distinct().count()
    none = docs.sparkSession.createDataFrame([("none", total - some)], "subject string, docs long")
    return assigned.groupBy("subject").agg(F.countDistinct("doc_id").alias("docs")).unionByName(none).withColumn("share", F.col("docs") / F.lit(max(1, total)))
