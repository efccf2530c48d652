import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import pack, plan, token_counts


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_holds_every_item_once_and_never_overfills(histogram):
    classes = plan(histogram, 60)
    held = Counter()
    for c in classes:
        assert c.count > 0 and sum(s * n for s, n in c.content) <= 60
        assert sum(n for s, n in c.content if 3 * s > 60) <= 2
        for s, n in c.content:
            held[s] += n * c.count
    assert dict(held) == histogram
    total, bins = sum(s * n for s, n in histogram.items()), sum(c.count for c in classes)
    assert bins <= max(1, 2 * -(-total // 60))


def test_little_room_is_lost():
    draw = random.Random(5)
    h = Counter(min(2048, int(draw.lognormvariate(5.5, 1))) or 1 for _ in range(20_000))
    classes = plan(h, 2048)
    used = sum(s * n for s, n in h.items())
    assert used / (2048 * sum(c.count for c in classes)) > 0.995


def test_pack_documents(spark):
    words = "alpha beta gamma delta epsilon".split()
    draw = random.Random(1)
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40, 300, 3000]))) for _ in range(120)] + ["", None] + ["same line"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as size", "2 as part", "3 as container_id")
    counts = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    rows = pack(df, capacity=512).collect()
    parts, load = defaultdict(list), Counter()
    for r in rows:
        parts[r.doc_id].append(r)
        if r.container_id is not None:
            load[r.container_id] += r.n_tokens
    assert set(parts) == set(range(len(texts))) and max(load.values()) <= 512
    for d, p in parts.items():
        p.sort(key=lambda r: r.part)
        assert [r.token_from for r in p] == [512 * k for k in range(len(p))] and p[-1].token_to == counts[d]
        assert len(p) == max(1, -(-counts[d] // 512))
        assert (p[0].container_id is None) == (counts[d] == 0)
    assert sum(counts.values()) / (512 * len(load)) > 0.9
    assert pack(df.limit(0)).count() == 0
