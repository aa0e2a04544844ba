import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomwork.llm import common, decontaminate, exactdedup, mixing, quality, shard, simhash, tokenbin, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, key int, fp string, h double"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(autouse=True)
def small_batches(monkeypatch):
    """Batches of a few rows, so that what goes on over a batch's end is met."""
    monkeypatch.setattr(common, "ARROW_ROWS", 7)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(VOCAB) + str(r.randint(0, 30)) for _ in range(k))
    texts = [say(r.randint(1, 80)) for _ in range(n)]
    texts += [texts[0]] * 30 + [texts[1].upper(), texts[1].replace(" ", "\n\t"), None, None, "", " \n ", "x", say(6000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[2]), (None, "only here"), (5, texts[5]), (5, "other text of five")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", [None, "a", "b", "", "é"][(d or 0) % 5], None, "x", 1, "y", 0.5) for d, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark):
    rows = corpus()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    want = []
    for d, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((d, keep, len(own), d == keep if d is not None and keep is not None else keep is None, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(x) for x in exactdedup.duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exactdedup.duplicates(empty(spark)).collect() == []


def prints(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [simhash.HOT_NODE, 1])
def test_simhash(spark, hot, monkeypatch):
    rows = corpus(2, 60)
    r = random.Random(3)
    long = " ".join(r.choice(VOCAB) + str(r.randint(0, 99)) for _ in range(900)).split()
    for k in range(25):
        own = list(long)
        for _ in range(k % 3):
            own[r.randrange(len(own))] = "changed"
        rows.append((1000 - k, " ".join(own)))
    fp = [prints(t) for _, t in rows]
    near = {a: [b for b in set(fp) if (a ^ b).bit_count() <= 2] for a in set(fp)}
    first = {}
    for start in near:
        if start not in first:
            seen, todo = {start}, [start]
            while todo:
                for b in near[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            least = min((d for (d, _), f in zip(rows, fp) if f in seen and d is not None), default=None)
            first |= dict.fromkeys(seen, least)
    got = simhash.near_duplicates(frame(spark, rows), hot).collect()
    assert sorted(((x[0], x[1] % 2**64, x[2]) for x in got), key=str) == sorted(((d, f, first[f]) for (d, _), f in zip(rows, fp)), key=str)
    kept = simhash.keep_representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    # one row a component, by text: a repeated id keeps each of its texts that no other row stands for
    reach = {}
    for f in near:
        seen, todo = {f}, [f]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[f] = min(seen)
    want = {}
    for (d, _), f in zip(rows, fp):
        want[reach[f]] = min(want.get(reach[f], (True, 0)), (d is None, d or 0))
    got = [(reach[prints(x.text)], (x.doc_id is None, x.doc_id or 0)) for x in kept.collect()]
    assert sorted(got) == sorted(want.items())
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_trie_and_components(spark):
    r = np.random.default_rng(1)
    v = np.unique(np.concatenate([x := r.integers(0, 2**63, 300, dtype=np.uint64), x[:80] ^ np.uint64(5), r.integers(0, 900, 300).astype(np.uint64)]))
    got = set()
    simhash.trie_join(v, 2, 63, lambda i, j: got.add((min(i, j), max(i, j))))
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 2)
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i < j}
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 101)]
    found = {x.v: x.root for x in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 105: 100}


def test_hot_nodes_give_the_same(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**62, 40)
    values = np.unique(np.concatenate([base, base ^ 3, base ^ (1 << 40), base & ~0xFFFF]))
    table = spark.createDataFrame([(int(x),) for x in values], "fp long")
    same = lambda hot: {(x.v, x.root) for x in simhash.components(simhash.links(table, hot)).collect()}
    assert same(10**9) == same(1)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, most):
    r = random.Random(4)
    say = lambda k: " ".join(r.choice(VOCAB) + str(r.randint(0, 9)) for _ in range(k))
    items = [(k, say(r.randint(10, 30))) for k in range(12)] + [(20, "short item é"), (21, None), (22, "..."), (None, say(12)), (23, "the the the the the the the the the the the the"), (24, say(9))]
    docs = [(k, say(r.randint(0, 60))) for k in range(60)]
    for k in range(40):
        words = words_of(items[k % 12][1])
        a = r.randint(0, len(words) - 1)
        docs.append((100 + k, say(r.randint(0, 9)) + " - " + ", ".join(words[a : a + r.randint(5, 14)]).upper() + " " + say(3)))
    docs += [(200, "A Short? ITEM É!"), (201, None), (202, ""), (203, "the " * 40), (204, items[15][1]), (None, items[0][1]), (205, items[17][1] + " " + items[3][1])]
    want = []
    for d, t in docs:
        w, hit, hits = words_of(t), set(), set()
        for item, text in items:
            q = words_of(text)
            n = min(len(q), 10)
            for g in {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        hits.add("" if item is None else str(item))
        want.append((d, len(w), len(hit), len(hits), hashlib.sha256(",".join(sorted(hits)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.contamination(frame(spark, docs), bench, most).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[5] for x in want) > 8
    if most:
        clean = decontaminate.keep_clean(frame(spark, docs), bench).collect()
        assert sorted(str(x.doc_id) for x in clean) == sorted(str(x[0]) for x in want if not x[5])
        assert decontaminate.contamination(empty(spark), bench).collect() == []
    none = decontaminate.contamination(frame(spark, docs), bench.limit(0), most).collect()
    assert not any(x.contaminated for x in none) and len(none) == len(docs)


def test_mixing(spark):
    rows = corpus(6, 400)
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((str(x.doc_id), x.size) for x in got) == sorted((str(d), size(t)) for d, t in rows)
    own = Counter()
    for x in docs.collect():
        own[x.source] += size(x.text)
    order = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(own)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * own[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(2 * own[s] for s in full)
        open_ -= full
        if not open_:
            break
    taken = Counter()
    for x in got:
        assert x.source_size == own[x.source] and x.target == pytest.approx(target[x.source])
        assert x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
    biggest = max(size(t) for _, t in rows)
    for s in own:
        assert abs(taken[s] - target[s]) <= biggest
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    copies = Counter((str(x.doc_id), x.text) for x in mixing.take(docs).collect())
    assert sum(copies.values()) == sum(x.copies for x in got)
    assert mixing.mix(empty(spark)).collect() == [] == mixing.take(empty(spark)).collect()


def test_sharding(spark):
    for rows in (corpus(7, 300), [(k, "t") for k in range(7)], [(1, "a")], [(1, "a")] * 9):
        n = len(rows)
        got = shard.shards(frame(spark, rows), 8).collect()
        assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
        assert sorted((x.shard, x.slot) for x in got) == sorted((p % 8, p // 8) for p in range(n))
        ranks = sorted(got, key=lambda x: x["rank"])
        assert [x["rank"] for x in ranks] == list(range(n))
        assert [x.doc_id for x in ranks if x.doc_id is not None] == sorted(d for d, _ in rows if d is not None)
    again = shard.shards(frame(spark, corpus(7, 300)), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, shard.shards(frame(spark, corpus(7, 300)).repartition(3), 8).collect()))
    assert shard.shards(empty(spark)).collect() == []


def test_feistel_is_a_shuffle(spark):
    for n in (1, 2, 3, 10, 97, 1000, 1024):
        x = [r[0] for r in spark.range(n).select(shard.feistel(__import__("pyspark").sql.functions.col("id"), n, 3)).collect()]
        assert sorted(x) == list(range(n))
    assert x != list(range(n))


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus(8, 80) + [(900, "a  b\n c <|endoftext|> it's  x  "), (901, "Öl, déjà-vu!! 12\nNew line.\n\nTwo")]
    raw = Tokenizer.from_file(file)
    want = []
    for d, t in rows:
        own = [*raw.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((str(d), len(own), zlib.crc32(np.array(own, "<u4"))))
    got = tokenbin.encode_and_read(frame(spark, rows), file).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32) for x in got) == sorted(want)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start) if x.doc_id is not None]
    assert order == sorted(order)
    assert tokenbin.encode_and_read(empty(spark), file).collect() == []


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 50257, 3000), np.zeros(600, int), np.array([5]), np.array([], int), r.integers(0, 3, 1024), np.array([70000, 1, 70000])):
        docs, lengths = [None, 7], np.array([len(ids), 0])
        back, own, m = tokenbin.decode_file(tokenbin.encode_file(docs, lengths, ids.astype(np.uint32)))
        assert back == docs and own.tolist() == lengths.tolist()
        assert m.ids().tolist() == ids.tolist()
        assert [m.access(i) for i in range(min(len(ids), 50))] == ids[:50].tolist()
        for v in [*set(ids[:20].tolist()), 99999]:
            places = np.flatnonzero(ids == v).tolist()
            assert m.count(v) == len(places) and list(m.occurrences(v)) == places
            assert m.rank(v, len(ids) // 2) == int((ids[: len(ids) // 2] == v).sum())


def test_quality(spark):
    r = random.Random(9)
    clean = lambda: " ".join(r.choice(VOCAB) for _ in range(r.randint(5, 60))).capitalize() + "."
    junk = lambda: " ".join(r.choice(VOCAB).upper() + "!!" for _ in range(r.randint(5, 60)))
    rows, labels = [], []
    for k in range(600):
        good = r.random() < 0.7
        rows.append((k, clean() if good else junk()))
        if k % 2:
            labels.append((k, int(good)))
    rows += [(700, None), (701, ""), (None, "x")]
    labels += [(None, 1), (3, None), (5, 0), (5, 1), (9999, 1)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    w = quality.train(docs, known)
    got = {x.doc_id: x for x in quality.score(docs, w).collect()}
    assert len(got) == len(rows)
    for x in got.values():
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    truth = {d: int("!!" not in (t or "")) for d, t in rows}
    held = [d for d, x in got.items() if x.held_out]
    assert sum(got[d].predicted == truth[d] for d in held) / len(held) > 0.97
    assert np.array_equal(quality.train(docs.repartition(5), known), w)
    kept = {x.doc_id for x in quality.keep_good(docs, known).collect()}
    assert kept == {d for d, x in got.items() if x.predicted}
    assert quality.score(empty(spark), w).collect() == []
    assert quality.score(docs, quality.train(empty(spark), known)).first().score == 0.5


def test_scores_ignore_neighbours():
    texts = ["One two three.", "", "FOUR!! FIVE!!", "one"]
    w = np.random.default_rng(2).normal(size=(1 << quality.BITS) + 1)
    whole = quality.batch_scores(pa.array(texts), w)
    assert np.allclose(whole, [quality.batch_scores(pa.array([t]), w)[0] for t in texts])


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.com/en/1", "http://EXAMPLE.com/en/77?x", "http://www.example.com/en/8", "http://b.net/de/", "https://x.example.net/de/81", "http://example.net/de/9#f", "http://q.org/es/1", "http://q.org/ES/1", "http://xcom/en/", "http://www.free-bets.example.org/a", "http://xfree-bets.org/", "http://com/en/", "http://a.com:80/en/", "://net/de/", "http://net/de", "http://www.spam-farm.example.com/en/71"]
    rules = [r for r in urlfilter.RULES if not r.pattern]
    want = []
    for k, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        m = re.match("([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        junk = [w for w in urlfilter.JUNK_HOSTS if re.search(rf"(^|[^a-z0-9]){w}($|[^a-z0-9])", host + path)]
        want.append((k, host, path, best.name if best else None, best.verdict if best else "block" if junk else "allow"))
    pages = spark.createDataFrame([(k, u, "h", "z") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    assert sorted(tuple(x)[:5] for x in urlfilter.judge_urls(pages).collect()) == want
    assert urlfilter.judge_urls(pages.limit(0)).collect() == []


def test_rules_are_found_by_their_rarest_token():
    r = random.Random(1)
    rules = [urlfilter.Rule("block", f"{r.choice(VOCAB)}.{r.choice(['com', 'net'])}", f"/{r.choice(VOCAB)}/{r.randint(0, 99)}") for _ in range(300)]
    index = urlfilter.Index(rules)
    assert max(map(len, index.by_token.values())) < 60
    for _ in range(2000):
        host, path = f"www.{r.choice(VOCAB)}.{r.choice(['com', 'net'])}", f"/{r.choice(VOCAB)}/{r.randint(0, 999)}"
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        got = index.judge(f"http://{host}{path}")
        assert got[2] == (max(fit, key=lambda x: len(x.name)).name if fit else None) or fit and len(got[2]) == max(len(x.name) for x in fit)
