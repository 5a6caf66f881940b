"""Every stage of the pipeline against brute force in plain Python, over rows with all that can be odd about them."""

import collections
import random

import pytest

import corpus_pipeline
from lineweave.llm import toxicity
from lineweave.llm.containment import K, NUM, DEN
from lineweave.plans.scratch import Scratch
from test_text_operators import WORD, vocabulary, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, kept string, taken long, mix_taken string, of string"


def rows_of(seed):
    rng, vocab = random.Random(seed), vocabulary(seed, 600)
    said = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, item = said(60), said(30)
    plain = [said(rng.randint(1, 90)) for _ in range(25)]
    texts = [*plain, None, None, "", " \n", "x", *(said(20) + " " + passage + " " + said(20) for _ in range(4)), said(40) + " " + item, item, "é " * 50 + said(5), said(9000)]
    texts += [plain[3], plain[3], plain[3] + " end", plain[4].upper(), *(said(60) + " grobian " + said(8) for _ in range(12))]
    ids = [i if i % 7 else None for i in range(len(texts))]
    ids[5] = ids[6] = 4  # one id for different texts
    rows = [(i, t, "en", rng.choice(["a", "b", None]), None if t is None else len(t), 1, 2, "k", 3, "m", "o") for i, t in zip(ids, texts)]
    rows += [rows[10], rows[10], rows[28]]  # equal rows
    return rows, item


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(texts):
    """For each text the first of those it is connected with by similarity."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def cut(texts, n=35):
    every = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in every for i in range(len(w) - n + 1))
    out = []
    for text, w in zip(texts, every):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone) if gone else text)
    return out


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module", params=[11, 12])
def given(request, spark, tmp_path_factory):
    rows, item = rows_of(request.param)
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grobian" in (t or ""))) for i, t, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "nowhere to be found in any of them at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, docs, folder


def test_toxic_rows_go(spark, given):
    rows, docs, folder = given
    load = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    model = toxicity.fit(spark, load("documents"), load("labels"))
    want = [r for r in rows if model.scores([r[1] or ""])[0] < toxicity.CUT]
    left = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert bag(left.collect()) == bag(want) and left.schema == docs.schema


def test_one_of_each_group_stays(spark, given):
    rows, docs, folder = given
    left = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    assert not bag(left) - bag(rows)
    members = collections.defaultdict(list)
    for r, g in zip(rows, groups([r[1] for r in rows])):
        members[g].append(r)
    for g in members.values():
        stay = [r for r in left if r in g]
        ids = [r[0] for r in g if r[0] is not None]
        if shingles(g[0][1]):
            assert len(stay) == 1 and stay[0][0] == min(ids, default=None)
    empty = [r for r in rows if not words(r[1])]
    assert bag(r for r in left if not words(r[1])) == bag(empty)


def test_repeats_are_cut(spark, given):
    rows, docs, folder = given
    want = [(r[0], t, *r[2:4], r[4] if t == r[1] else len(t), *r[5:]) for r, t in zip(rows, cut([r[1] for r in rows]))]
    left = corpus_pipeline.cut_repeats(spark, docs, folder)
    assert bag(left.collect()) == bag(want) and left.columns == docs.columns


def test_leaks_go(spark, given):
    rows, docs, folder = given
    bare = lambda t: " ".join("".join(" " if ord(c) < 128 and not c.isalnum() else c for c in t or "").split(" "))
    items = [shingles(bare(r.text), K) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = lambda t: any(i and DEN * len(i & shingles(bare(t), K)) >= NUM * len(i) for i in items)
    left = corpus_pipeline.drop_leaks(spark, docs, folder)
    assert bag(left.collect()) == bag(r for r in rows if not leaks(r[1])) and sum(leaks(r[1]) for r in rows) >= 2


def test_the_mix_takes_what_it_should(spark, given):
    rows, docs, folder = given
    left = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, cap, total = dict(zip(order, (5, 2, 1))), {s: 3 * size[s] for s in order}, sum(size.values())
    target, open_ = {}, set(order)
    while True:  # water filling
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in left:
        taken[r.source] += r.mix_taken_ if "mix_taken_" in r.__fields__ else r[-1]
        assert 0 < r[-1] <= 3 * len(WORD.findall(r.text))
    assert all(abs(taken[s] - target[s]) <= 1 for s in order if size[s])
    assert not bag(tuple(r)[: len(rows[0])] for r in left) - bag(rows)


def test_empty_tables(spark, given):
    _, docs, folder = given
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []


def test_stages_follow_each_other(spark, given):
    rows, docs, folder = given
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = Scratch(spark, "t").write(stage(spark, step, folder))
    assert bag(corpus_pipeline.run(spark, folder).select("doc_id", "text", "source").collect()).keys() <= {(i, t, s) for i, t, s in step.select("doc_id", "text", "source").collect()}
