"""The corpus operators against plain restatements on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import jaccard_join, line_dedup, mixing, packing, quality_rules, url_filter
from kgspark.llm.queries import URL_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = "A line that is quite long and stands in very many documents of the table"
EDGES = [
    (1000, None, "s1"),
    (1001, "", "s1"),
    (1002, " \n\t ", None),
    (1003, "one two three", "s2"),
    (1004, "ONE two Three", "s2"),
    (1005, "one two three", "s2"),
    (1006, "x" * 300_000, "s3"),
    (1007, ("many words of one very long text " * 20_000), "s3"),
    (1008, "a\u00a0b c\u2003d \x1c e \x85 f <|endoftext|> don't 12½ ΑΣ Σ", "s4"),
    *[(1010 + i, f"first line {i}\n  {COMMON.upper() if i % 2 else COMMON} \nlast", "s5") for i in range(6)],
    (1020, COMMON + "\n" + COMMON, "s5"),
    (1021, COMMON + "\n" + COMMON, "s5"),
    (None, "no key here but some words to count and keep", "s6"),
    (1003, "one two three", "s2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame(EDGES, "doc_id long, text string, source string")
    # Extra columns with names that operators use themselves.
    return real.unionByName(odd).withColumns({"size": F.lit("x"), "kept": F.lit(1), "component": F.lit(2), "n": F.lit(3), "host": F.lit("h"), "__n": F.lit(0)}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def bag(items):
    return Counter(map(tuple, items))


def base(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for starts in at.values() if len(starts) > 1 for i in starts for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_measures(docs, rows):
    got = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert bag(r[:7] for r in got) == bag((k, *base(t)) for k, t, _ in rows)
    assert all(r.kept != r.base_failed for r in got)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    table = [(i, bad if i % 20 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 20 else bad, f"h{i % 7}") for i in range(400)] + [(5000, good, None), (5001, bad, "tiny")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == {i for i, t, s in table if t == good and s != "bad"}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for frame in (
        quality_rules.judge(none),
        quality_rules.keep_good(none),
        line_dedup.digest(line_dedup.drop_frequent_lines(none)),
        mixing.copies(none),
        mixing.mix(none),
        jaccard_join.similar_documents(none),
        jaccard_join.keep_one(none),
        packing.pack_documents(none, tokenizer_path()),
    ):
        assert frame.collect() == []


def lines_brute(rows):
    strip = " \t\n\x0b\x0c\r"
    fold = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    n, top = Counter(), {}
    for doc, text, _ in rows:
        for key in {fold(x) for x in (text or "").split("\n")}:
            n[key] += 1
            top[key] = max(top.get(key, -1), -1 if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(fold(x)) >= 40 and n[fold(x)] >= 5 and top[fold(x)] != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return bag(out)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(docs, rows, limit):
    got = line_dedup.drop_frequent_lines(docs, broadcast_limit=limit)
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    assert bag(line_dedup.digest(got).collect()) == lines_brute(rows)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 50_000).astype(np.uint64))
    made = line_dedup.PerfectHash(keys)
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.PerfectHash(keys[:0]).size == 0


def targets_brute(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free and total > 1e-9:
        share = sum(weight[s] for s in free)
        over, new = [], total
        for s in free:
            if total * weight[s] / share >= most * sizes[s]:
                over.append(s)
        for s in over:
            target[s] = float(most * sizes[s])
            new -= target[s]
            free.remove(s)
        if not over:
            for s in free:
                target[s] = total * weight[s] / share
            break
        total = new
    return target


def test_mixing(docs, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets_brute(sizes)
    got = mixing.copies(docs).collect()
    assert bag((r.doc_id, r["size"], r.source) for r in got) == bag((k, len(WORD.findall(t or "")), s) for k, t, s in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * largest[s] + 1
    assert bag(mixing.copies(docs).collect()) == bag(got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {r[:2] for r in rows}
    assert [mixing._digits(n) for n in (0, 10**6, 10**6 + 1, 16 * 10**6, 17 * 10**6)] == [1, 1, 2, 2, 3]
    assert Counter(r.doc_id for r in mixed.collect()) == sum((Counter({r.doc_id: r.copies}) for r in got), Counter())


def grams(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def components_brute(rows, n, percent):
    """Size of each row's set, and a number of its component; None without words."""
    sets = [grams(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    return [(len(s), find(i) if s else None) for i, s in enumerate(sets)]


def joined_brute(rows, n, percent):
    placed = components_brute(rows, n, percent)
    least = {}
    for (doc, _, _), (_, component) in zip(rows, placed):
        if doc is not None:
            least[component] = min(least.get(component, doc), doc)
    return bag((doc, size, doc if component is None else least.get(component)) for (doc, _, _), (size, component) in zip(rows, placed))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, n, percent):
    assert bag(jaccard_join.similar_documents(docs, words=n, percent=percent).collect()) == joined_brute(rows, n, percent)


def test_jaccard_join_of_many_texts_under_one_key(spark):
    rng = np.random.default_rng(3)
    table = []
    for group in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 30)]
        for k in range(int(rng.integers(1, 4))):
            own = list(words)
            own[-1 - k] = f"v{group}"
            # Most under one key, some of these rows repeated; a few under keys of their own or none.
            key = 7 if rng.random() < 0.9 else None if rng.random() < 0.2 else 1_000 + len(table)
            table += [(key, " ".join(own), "s")] * int(rng.choice([1, 1, 1, 3]))
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    assert bag(jaccard_join.similar_documents(docs, words=2, percent=80).collect()) == joined_brute(table, 2, 80)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_near_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    table = []
    for group in range(25):
        words = [f"w{x}" for x in rng.integers(0, 40, int(rng.choice([3, 5, 7, 9, 12, 20, 40, 90])))]
        for _ in range(int(rng.integers(2, 14))):
            own = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
                own[int(rng.integers(len(own)))] = f"v{rng.integers(50)}"
            table.append((len(table), " ".join(own), "s"))
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    assert bag(jaccard_join.similar_documents(docs, words=2, percent=80).collect()) == joined_brute(table, 2, 80)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_by_rare_tokens(spark, monkeypatch, seed):
    """Signatures of a passage that many texts share: its sets are split by their rare tokens."""
    monkeypatch.setattr(jaccard_join, "SPLIT_PAIRS", 0 if seed else 50)
    monkeypatch.setattr(jaccard_join, "FRONT", 1)
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    table = []
    for k in range(150):
        words = passage + [f"w{x}" for x in rng.integers(0, 12 if k % 2 else 500, int(rng.integers(1, 9)))]
        table.append((k if k % 10 else None, " ".join(words), "s"))
    table += [(200, " ".join(passage), "s"), (201, "", "s"), (202, table[3][1], "s"), (3, "a text of the same key", "s")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    for n, percent in ((2, 85), (1, 80)):
        assert bag(jaccard_join.similar_documents(docs, words=n, percent=percent).collect()) == joined_brute(table, n, percent)


def test_rare_signatures_meet_all_links():
    """Linked sets share a signature; sets that share only a passage share none."""
    rng = np.random.default_rng(4)
    sets = []
    for group in range(30):
        base = rng.integers(0, 10**6, int(rng.integers(3, 120)))
        for _ in range(5):
            own = set(base.tolist())
            for _ in range(int(rng.integers(0, 1 + len(base) // 6))):
                own.discard(int(rng.choice(base)))
                if rng.integers(2):
                    own.add(int(rng.integers(0, 10**6)))
            sets.append(own)
    crowd = [{*range(k * 8, k * 8 + 8), *range(10**7, 10**7 + 42)} for k in range(40)]
    arrays = [np.array(sorted(x), np.uint64) for x in sets + crowd]
    counts = np.bincount(np.concatenate(arrays).astype(np.int64) % jaccard_join.TOKEN_BUCKETS, minlength=jaccard_join.TOKEN_BUCKETS)
    by = [set(jaccard_join.rare_signatures(x, counts, jaccard_join.size_steps(200), 85).tolist()) for x in arrays]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                assert by[i] & by[j]
    assert not any(by[len(sets) + i] & by[len(sets) + j] for i in range(40) for j in range(i))


def one_each(rows, n, percent):
    """Per component the row with the smallest key, nulls last; rows without words all."""
    parts = defaultdict(list)
    for row, (_, component) in zip(rows, components_brute(rows, n, percent)):
        parts[component].append(row)
    out = []
    for component, own in parts.items():
        out += own if component is None else [min(own, key=lambda r: (r[0] is None, r[0] or 0))[:1]]
    return out


def test_keep_one(docs, rows):
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    assert bag([r.doc_id] for r in kept) == bag(r[:1] for r in one_each(rows, 5, 80))
    assert {(r.doc_id, r.text) for r in kept} <= {r[:2] for r in rows}


def test_links_through_rows_without_a_key(spark):
    """Texts whose rows all have a null key, or a key that other texts have too."""
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(words[:-k] + [f"x{k}{i}" for i in range(k)])
    # b links with a and c, which do not link with each other.
    a, b, c = near(6), near(3), " ".join(words[:-3] + ["y1", "y2", "y3"]).replace("w1 ", "z ", 1)
    for table in ([(5, a), (None, b), (7, "other words in a row here")], [(5, a), (None, b), (9, c), (None, b)], [(None, a), (None, b), (None, b)], [(5, a), (5, "other words in a row here"), (5, b), (5, b), (8, a)]):
        rows = [(k, t, "s") for k, t in table]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert bag(jaccard_join.similar_documents(docs).collect()) == joined_brute(rows, 5, 80)
        assert bag([r.doc_id] for r in jaccard_join.keep_one(docs).collect()) == bag(r[:1] for r in one_each(rows, 5, 80))


def test_bitmaps_are_lower_bounds(spark):
    rng = np.random.default_rng(2)
    for n in (10, 1024, 1500, 2100, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 7).astype(np.uint64)]))
        sizes = np.array([len(a), len(b)])
        words = np.array([16 * 2 ** (n % 3), 64])
        cells = jaccard_join.bitmaps(np.concatenate([a, b]), sizes, words).to_pylist()
        apart = spark.createDataFrame([cells], "x array<long>, y array<long>").select(jaccard_join.bits_apart(F.col("x"), F.col("y"))).first()[0]
        assert 0 < apart <= len(np.setxor1d(a, b)) and (len(np.setxor1d(a, b)) - apart) % 2 == 0


def test_signatures_meet_for_linked_sets():
    """Linked sets share a signature, whatever the band."""
    rng = np.random.default_rng(1)
    bands = jaccard_join.bands_of(400, 85)
    for band in bands:
        band.allocate(1000)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + len(a) // 8))):
            b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 2**63, dtype=np.uint64))
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) or both != len(a):
            if 100 * both >= 85 * (len(a) + len(b) - both):
                sig, own = jaccard_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands, 85)
                assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


@pytest.mark.parametrize("part_rows", [packing.PART_ROWS, 3])
def test_packing(docs, rows, monkeypatch, part_rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_ROWS", part_rows)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[b : b + 4096] for b in range(0, len(ids), 4096))]
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert bag(r[:5] for r in got) == bag(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in got) // 4096) + 1


def test_word_tokens(monkeypatch):
    """Ids of random texts by words, with a cache that is cleared often, against whole texts."""
    rng = np.random.default_rng(3)
    parts = ["a", "Be", "don't", "it'", "'s", ".", "...", "###", "É", "e\u0301", "ß", "Σ", "İ", "12", "x1", "ſ", "漢字", "\u00a0", "\u2028", "\x85", "\x1d", " ", " ", "  ", "\n", "\t", "<s>", "-", "_", "🙂", "ª", "ǅ"]
    texts = ["", " ", *("".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(600))]
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    tokens = packing.WordTokens(tokenizer_path())
    assert tokens.encode([]) == []
    for k in range(0, len(texts), 50):
        some = texts[k : k + 50]
        whole = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(some)] == whole


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1?x#y", "https://example.org/en/17", "http://example.org/en/2", "http://badexample.org/es/", "http://a.com/fr/", "x://a.com/de", "x://a.com/de/#", "no scheme", None, "", "http://net?x", "http://org/", "http://com:80/de/", "a://b://org/\nx", "http://example.org", "http://example.org/en/" + "1" * 300_000, "http://example.org/" + "es" * 200_000 + "/", "http://a." + "b." * 3000 + "org/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id long, url string, host string")
    rules = [(v, *re.match(r"([^/]*)(.*)", e).groups()) for v, e in URL_RULES]

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
        fit = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    got = {r.page_id: tuple(r[1:]) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)} | {None: brute(urls[0])}
