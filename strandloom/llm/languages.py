"""Languages of documents and of their passages: averaged hashed subword embeddings with a linear softmax.

A word's vector is the mean of the embeddings of its hashed character n-grams, a sentence's vector the mean of its words'
vectors, and a linear layer with softmax turns it into probabilities. As all of it up to the softmax is linear, a word's share of the
logits can be kept: applying the model to a text is a sum over its words.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut

# ISO 639-1 code, ISO 639-2 codes (terminological, bibliographic) and English name of languages written with the letters of Europe.
LANGUAGES = """
bg bul bul bulgarian
ca cat cat catalan
cs ces cze czech
da dan dan danish
de deu ger german
el ell gre greek
en eng eng english
es spa spa spanish
et est est estonian
eu eus baq basque
fi fin fin finnish
fr fra fre french
ga gle gle irish
gl glg glg galician
hr hrv hrv croatian
hu hun hun hungarian
is isl ice icelandic
it ita ita italian
lt lit lit lithuanian
lv lav lav latvian
mt mlt mlt maltese
nl nld dut dutch
no nor nor norwegian
pl pol pol polish
pt por por portuguese
ro ron rum romanian
ru rus rus russian
sk slk slo slovak
sl slv slv slovenian
sv swe swe swedish
tr tur tur turkish
uk ukr ukr ukrainian
"""
# Further names.
MORE_NAMES = {"castilian": "es", "flemish": "nl", "nb": "no", "nn": "no"}

NAMES = {name: line.split()[0] for line in LANGUAGES.strip().splitlines() for name in line.split()} | MORE_NAMES

# Words that end in a full stop without ending a sentence, in lower case.
ABBREVIATIONS = set("abs al art bzw cf dr etc exp fol mag mm mme mr mrs ms nn no nos nr núm num p pag pág para paras pp prof rn rz s sect sr sra sig st u v vgl vol vs".split())

BUCKETS, WIDTH = 1 << 15, 16
#: Words whose logits a Python worker keeps.
KEPT = 500_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def label_code(c: str):
    """ISO 639-1 code that a label names, with or without region, code or English name, in any case; null if it names none."""
    first = F.regexp_extract(F.lower(F.trim(F.col(c))), r"^([a-z]+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.when(F.col(c).isNotNull(), first))


def word_key(token: str) -> str:
    """The letters of a token in lower case and without accents, which scans lose; empty if it has no letter or holds a digit."""
    w = _EDGE.sub("", token)
    if not w or any(ch.isdigit() for ch in w):
        return ""
    return w.lower() if w.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", w) if not unicodedata.combining(ch)).lower()


def grams(word: str) -> np.ndarray:
    """Hashed n-grams of 2 to 5 letters of a word with its edges, and the word itself."""
    w = f"<{word}>"
    codes = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in (2, 3, 4, 5, len(w)):
        if n <= len(codes):
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(1099511628211)
            out.append((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Sentences:
    """Sentences of the texts of a batch: ``text`` is the row each belongs to, ``words`` the number of its words, ``whole`` whether it ends as sentences
    do (titles don't; one that ends with an initial or abbreviation is whole if half of its tokens start with a small letter); ``begin`` and ``end`` are each sentence's stretch of ``index``, the numbers of its tokens among the ``distinct`` ones."""

    text: np.ndarray
    words: np.ndarray
    whole: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    index: np.ndarray
    distinct: list[str]


_STOP = re.compile(r"[.!?…:;]?[.!?…][\"'”“’»«)\]]*$")
#: At the start of a line: paragraph numbers, page rules, and a heading of one word with a colon.
_MARK = re.compile(r"^(?:\[\d+\]|\(?\d+[.)]|§+|Rn\.|--)|^\w+:$")


#: Marks that open a quotation or a parenthesis.
_OPENING = "«„“\"'‘([¿¡"


def _ends(token: str) -> bool:
    if not _STOP.search(token):
        return False
    bare = _EDGE.sub("", token)
    last = token.endswith(bare + ".")  # nothing closes between the word and its full stop
    return not (last and (not bare or bare.isdigit() or len(bare) == 1 or bare.lower() in ABBREVIATIONS))


def _starts(token: str) -> bool:
    c = token[0]
    return c.isupper() or c.isdigit() or c in "[(«„“\"'§‘¿¡-–—█*"


def sentences(texts: pa.Array) -> Sentences:
    """Cuts at full stops, question and exclamation marks before something that can start a sentence, and before paragraph marks at the start of a line, as
    which a bare number counts if a capital follows, in quotation marks or not, and the line before ends with a name or a number.

    Lines as such are no boundary: texts are wrapped anywhere. Nothing is cut off; whole texts are read.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(pc.replace_substring(texts, "\n", " \n¶ "))
    enc = lists.flatten().dictionary_encode()
    distinct = enc.dictionary.to_pylist()
    index = enc.indices.to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    line = np.fromiter((t == "¶" for t in distinct), bool, len(distinct))
    ends = np.fromiter((bool(t) and _ends(t) for t in distinct), bool, len(distinct))
    starts = np.fromiter((bool(t) and _starts(t) for t in distinct), bool, len(distinct))
    marks = np.fromiter((bool(_MARK.match(t)) for t in distinct), bool, len(distinct))
    number = np.fromiter((t.isdigit() for t in distinct), bool, len(distinct))
    capital = np.fromiter((t.lstrip(_OPENING)[:1].isupper() for t in distinct), bool, len(distinct))
    formal = np.fromiter((t[:1].isupper() or any(ch.isdigit() for ch in t) for t in distinct), bool, len(distinct))
    word = np.fromiter((any(ch.isalpha() for ch in t) for t in distinct), bool, len(distinct))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(index):
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z.astype(bool), z, z, index, distinct)
    after_line = np.r_[True, line[index[:-1]]]
    empty = np.fromiter((not t for t in distinct), bool, len(distinct))
    real = np.flatnonzero(~(line | empty)[index])
    after_line, index, owner = after_line[real], index[real], owner[real]
    if not len(index):
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z.astype(bool), z, z, index, distinct)
    bare = number[index[1:]] & np.r_[capital[index[2:]], False][: len(index) - 1] & formal[index[:-1]]
    new = np.r_[True, (ends[index[:-1]] & starts[index[1:]]) | (after_line[1:] & (marks[index[1:]] | bare)) | (owner[1:] != owner[:-1])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(index)]
    hyphen = np.fromiter((t.endswith("-") and len(t) > 1 for t in distinct), bool, len(distinct))
    small = np.fromiter((t[:1].islower() for t in distinct), bool, len(distinct))
    cut_word = np.r_[hyphen[index[:-1]] & after_line[1:] & small[index[1:]], False]  # its rest, on the next line, counts
    counts = np.r_[0, np.cumsum(word[index] & ~cut_word)]
    closes = np.fromiter((bool(_STOP.search(t)) for t in distinct), bool, len(distinct))
    low = np.r_[0, np.cumsum((word & small)[index])]
    # an initial or abbreviation may end a sentence or a title; titles are mostly names and numbers
    whole = ends[index[end - 1]] | (closes[index[end - 1]] & (2 * (low[end] - low[begin]) >= end - begin))
    return Sentences(owner[begin], counts[end] - counts[begin], whole, begin, end, index, distinct)


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    accuracy: float = 0.0
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def word_logits(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each token's word, and whether it has one."""
        out = np.zeros((len(tokens), len(self.languages)), np.float64)
        has = np.zeros(len(tokens), bool)
        for i, t in enumerate(tokens):
            got = self.known.get(t)
            if got is None:
                w = word_key(t)
                got = self.embedding[grams(w)].mean(axis=0) @ self.weight if w else np.zeros(0)
                if len(self.known) < KEPT and len(t) < 64:
                    self.known[t] = got
            if len(got):
                out[i], has[i] = got, True
        return out, has

    def sentence_probabilities(self, s: Sentences) -> np.ndarray:
        """A row of calibrated probabilities for each sentence; even if it has no word."""
        k = len(self.languages)
        if not len(s.begin):
            return np.zeros((0, k))
        logits, has = self.word_logits(s.distinct)
        total = np.add.reduceat(logits[s.index], s.begin, axis=0)
        n = np.add.reduceat(has[s.index].astype(np.int64), s.begin)
        z = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[n == 0] = 1 / k
        return p


@dataclass
class _Bags:
    """Sentences as numbers of distinct words, and the n-grams of those words."""

    sentences: list[np.ndarray]
    grams: np.ndarray
    begin: np.ndarray

    def take(self, at: np.ndarray) -> _Bags:
        return _Bags([self.sentences[i] for i in at], self.grams, self.begin)


def _bags(s: Sentences, rows: np.ndarray) -> _Bags:
    keys = [word_key(t) for t in s.distinct]
    used = {k: i for i, k in enumerate(sorted({keys[t] for r in rows for t in s.index[s.begin[r] : s.end[r]]} - {""}))}
    number = np.array([used.get(k, -1) for k in keys])
    made = [grams(k) for k in used]
    bags = []
    for r in rows:
        w = number[s.index[s.begin[r] : s.end[r]]]
        bags.append(w[w >= 0])
    return _Bags(bags, np.concatenate(made) if made else np.zeros(0, np.int64), np.r_[0, np.cumsum([len(g) for g in made])].astype(np.int64))


def _sgd(bags: _Bags, y: np.ndarray, k: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minibatch gradient descent on the softmax loss, the rate falling linearly to zero."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    usable = np.array([i for i, x in enumerate(bags.sentences) if len(x)], np.int64)
    size = 64
    step, steps = 0, max(1, epochs * -(-len(usable) // size))
    for _ in range(epochs):
        rng.shuffle(usable)
        for at in range(0, len(usable), size):
            pick = usable[at : at + size]
            lengths = np.array([len(bags.sentences[i]) for i in pick])
            words, place = np.unique(np.concatenate([bags.sentences[i] for i in pick]), return_inverse=True)
            owner = np.repeat(np.arange(len(pick)), lengths)
            mean = np.bincount(owner * len(words) + place, weights=1 / lengths[owner], minlength=len(pick) * len(words)).reshape(len(pick), len(words)).astype(np.float32)
            many = bags.begin[words + 1] - bags.begin[words]
            first = np.r_[0, np.cumsum(many)[:-1]]
            ids = bags.grams[np.repeat(bags.begin[words] - first, many) + np.arange(many.sum())]
            h = mean @ (np.add.reduceat(emb[ids], first, axis=0) / many[:, None].astype(np.float32))
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = (mean.T @ (p @ w.T)) / many[:, None].astype(np.float32)
            w -= now * (h.T @ p) / len(pick) * 4
            b -= now * p.mean(axis=0)
            order = np.argsort(ids)
            ids = ids[order]
            new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            emb[ids[new]] -= now * 4 * np.add.reduceat(np.repeat(back, many, axis=0)[order], new, axis=0)
            step += 1
    return emb, w, b


def fit(texts: list[str], labels: list[str], per_language: int = 1200, epochs: int = 6, rate: float = 1.3, seed: int = 11) -> Model:
    """Trains on up to ``per_language`` sentences of labelled texts for each label; many labels may be wrong.

    A first model is trained on all of them and judges every sentence. Sentences whose label it doesn't share, and languages of which it
    shares less than half of the sentences, are taken to be mislabelled and left out of the second training. A held-out fifth gives the
    temperature (smallest log loss) and the rejection threshold, the lowest confidence down to which at least 995 of 1000 are right. Both are found on
    random stretches of eight words of the held-out sentences, as whole sentences are too easy to tell doubt from certainty.
    """
    s = sentences(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(seed)
    rows = rng.permutation(np.flatnonzero((s.words >= 8) & s.whole))
    lab = np.array(labels, dtype=object)[s.text]
    kinds = sorted({x for x in lab[rows]})
    if not kinds:
        return Model(["und"], np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 1)), np.zeros(1), 1.0, 2.0)
    rows = np.concatenate([rows[lab[rows] == x][:per_language] for x in kinds])
    rows = rng.permutation(rows)
    number = {x: i for i, x in enumerate(kinds)}
    y, bags = np.array([number[x] for x in lab[rows]]), _bags(s, rows)

    def judged(part: np.ndarray, model: Model) -> np.ndarray:
        sub = Sentences(s.text[part], s.words[part], s.whole[part], s.begin[part], s.end[part], s.index, s.distinct)
        used, place = np.unique(np.concatenate([sub.index[a:b] for a, b in zip(sub.begin, sub.end)] or [np.zeros(0, np.int64)]), return_inverse=True)
        logits, has = model.word_logits([s.distinct[t] for t in used])
        z, at = np.zeros((len(part), len(model.languages))), 0
        for i, n in enumerate(sub.end - sub.begin):
            t = place[at : at + n]
            at += n
            t = t[has[t]]
            z[i] = (logits[t].mean(axis=0) if len(t) else 0) + model.bias
        return z

    first = Model(kinds, *_sgd(bags, y, len(kinds), max(1, epochs // 2), rate, seed))
    agree = judged(rows, first).argmax(axis=1) == y
    good = [i for i in range(len(kinds)) if agree[y == i].mean() >= 0.5] or list(range(len(kinds)))
    keep = agree & np.isin(y, good)
    renumber = {g: i for i, g in enumerate(good)}
    y = np.array([renumber.get(v, -1) for v in y])
    held = np.arange(len(rows)) % 5 == 0
    learn = np.flatnonzero(keep & ~held)
    model = Model([kinds[g] for g in good], *_sgd(bags.take(learn), y[learn], len(good), epochs, rate, seed + 1))
    test = np.flatnonzero(keep & held)
    model.accuracy = float((judged(rows[test], model).argmax(axis=1) == y[test]).mean()) if len(test) else 0.0
    at, long = s.begin[rows[test]], s.end[rows[test]] - s.begin[rows[test]]
    s.begin[rows[test]] = at + (rng.random(len(test)) * np.maximum(long - 7, 1)).astype(np.int64)
    s.end[rows[test]] = np.minimum(s.begin[rows[test]] + 8, at + long)
    z, t = judged(rows[test], model), y[test]

    def loss(temperature: float) -> float:
        q = z / temperature
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(t)), t]).mean()) if len(t) else 0.0

    model.temperature = float(min(np.geomspace(0.1, 1000, 120), key=loss))
    q = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    conf, right = (q / q.sum(axis=1, keepdims=True)).max(axis=1), z.argmax(axis=1) == t
    order = np.argsort(-conf)
    ok = np.cumsum(right[order]) >= 0.995 * np.arange(1, len(order) + 1)
    model.threshold = float(np.clip(conf[order][np.flatnonzero(ok)[-1]] if ok.any() else 1.0, 0.5, 0.95))
    return model


def _level(sizes: list[int], total: int) -> int:
    """The largest cap under which the sizes sum to at most ``total``, 1 at least."""
    left, n = total, len(sizes)
    for i, x in enumerate(sorted(sizes)):
        if x * (n - i) > left:
            return max(1, left // (n - i))
        left -= x
    return max(sizes, default=1)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000, max_chars: int = 6_000_000) -> Model:
    """A model from at most ``sample_rows`` labelled rows (and ``max_chars`` characters) of ``df``, drawn within each label by hash of the text, of equal texts one.

    Labels share the rows evenly, and what rare labels leave goes to the others. If the texts are too long together, the longest are cut to an even length, at
    a blank; none is left out. The labels' notations are read by ``label_code``; rows without a readable label or without text are not drawn.
    """
    labelled = df.select(F.col(text_col).alias("text"), label_code(lang_col).alias("lang")).where("lang IS NOT NULL")
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # codes of LANGUAGES; texts aren't read for it
    marked = labelled.where("length(text) > 0").withColumn("o", F.xxhash64("text"))
    quota = _level(list(have.values()), sample_rows)
    drawn = F.lit(False)
    for lang, n in have.items():
        upto = int(-(2**63) + min(1.0, (1.5 * quota + 20) / n) * (2**64 - 2**11))
        drawn = F.when(F.col("lang") == lang, F.col("o") <= upto).otherwise(drawn)
    few = marked.where(drawn).groupBy("o").agg(F.min_by("text", "lang").alias("text"), F.min("lang").alias("lang"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("r") <= quota).select("o", "lang", "text", F.length("text").alias("n"))
    few = cut(few.orderBy("o").limit(sample_rows))
    most = _level([r["n"] for r in few.select("n").collect()], max_chars)
    rows = few.orderBy("o").select(F.left("text", F.lit(most + 1)).alias("text"), "lang").toArrow()
    texts = [x if len(x) <= most else x[: max(x.rfind(" ", 0, most + 1), 0) or most] for x in rows["text"].to_pylist()]
    return fit(texts, rows["lang"].to_pylist())


SEGMENTS = "doc_id bigint, segment int, lang string, confidence double, n_words bigint, n_sentences int, longest bigint, text string"


def segments(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, with_text: bool = False) -> DataFrame:
    """Rows ``doc_id, segment, lang, confidence, n_words, n_sentences, longest[, text][, label]``: the passages of each document in order, a passage being neighbouring
    sentences in one language; ``longest`` is the number of words of its longest whole sentence (one that ends with a full stop or the like, as titles do not) whose own confidence passes the model's threshold.

    A sentence whose best probability is below the threshold, or that has fewer than four words, is no evidence of its own and goes
    with the passage around it; if a document has no better sentence at all, its language is null (rejected). ``confidence`` is the mean of the
    evidence's probabilities, weighted by words, and 0 if rejected. A document that is null, empty or blank has one row without language and with 0 words.
    Repeated rows give repeated results. ``label`` is the code that ``lang_col`` names. Other columns are left out.
    """
    schema = SEGMENTS if with_text else SEGMENTS.rsplit(", ", 1)[0]
    picked = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([label_code(lang_col).alias("label")] if lang_col else []))
    schema += ", label string" if lang_col else ""

    def apply(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            s = sentences(b.column(1))
            p = model.sentence_probabilities(s)
            best, conf = p.argmax(axis=1), p.max(axis=1) if len(p) else np.zeros(0)
            firm = (conf >= model.threshold) & (s.words >= 4)
            docs = b.num_rows
            lang = np.where(firm, best, -1)
            # a sentence without evidence takes the language before it, at a document's start the one after it
            at = np.arange(len(lang))
            before = np.maximum.accumulate(np.where(firm, at, -1)) if len(lang) else at
            after = np.minimum.accumulate(np.where(firm, at, len(lang))[::-1])[::-1] if len(lang) else at
            prev_ok = (before >= 0) & (s.text[np.maximum(before, 0)] == s.text) if len(lang) else firm
            next_ok = (after < len(lang)) & (s.text[np.minimum(after, len(lang) - 1)] == s.text) if len(lang) else firm
            lang = np.where(prev_ok, lang[np.maximum(before, 0)], np.where(next_ok, lang[np.minimum(after, len(lang) - 1)], -1)) if len(lang) else lang
            new = np.r_[True, (lang[1:] != lang[:-1]) | (s.text[1:] != s.text[:-1])] if len(lang) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            if len(begin):
                words = np.add.reduceat(s.words, begin)
                mass = np.add.reduceat(np.where(firm, s.words, 0), begin)
                score = np.add.reduceat(np.where(firm, s.words * conf, 0.0), begin)
                count = np.diff(np.r_[begin, len(lang)])
                longest = np.maximum.reduceat(np.where(firm & s.whole, s.words, 0), begin)
                owner, code = s.text[begin], lang[begin]
                ordinal = np.arange(len(begin)) - np.maximum.accumulate(np.where(np.r_[True, owner[1:] != owner[:-1]], np.arange(len(begin)), 0))
            else:
                words = mass = count = longest = owner = code = ordinal = np.zeros(0, np.int64)
                score = np.zeros(0)
            bare = np.setdiff1d(np.arange(docs), owner)
            row = np.r_[owner, bare].astype(np.int64)
            pad = np.zeros(len(bare), np.int64)
            names = [*(model.languages[c] if c >= 0 else None for c in code), *[None] * len(bare)]
            cols = [b.column(0).take(pa.array(row)), pa.array(np.r_[ordinal, pad], pa.int32()), pa.array(names, pa.string()), pa.array(np.r_[np.where(mass > 0, score / np.maximum(mass, 1), 0.0), pad.astype(float)]), pa.array(np.r_[words, pad], pa.int64()), pa.array(np.r_[count, pad], pa.int32()), pa.array(np.r_[longest, pad], pa.int64())]
            if with_text:
                stop = np.r_[begin[1:], len(lang)] if len(begin) else begin
                cols.append(pa.array([" ".join(s.distinct[t] for t in s.index[s.begin[x] : s.end[y - 1]]) for x, y in zip(begin, stop)] + [""] * len(bare), pa.string()))
            if lang_col:
                cols.append(b.column(2).take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    return picked.mapInArrow(apply, schema)


def disputed(parts: DataFrame, min_words: int = 10) -> DataFrame:
    """``doc_id, lang`` of the languages used in documents that use more than one, or whose label doesn't name the one used.

    A language is used if a sentence of at least ``min_words`` words is written in it.
    """
    used = parts.where(F.col("lang").isNotNull() & (F.col("longest") >= min_words)).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    case = (F.size("langs") > 1) | F.col("label").isNull() | (F.element_at("langs", 1) != F.col("label"))
    return used.where(case).select("doc_id", F.explode("langs").alias("lang"))
