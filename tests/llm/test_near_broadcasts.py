import random
import time

from bourse.llm import near_copies, simhash
from bourse.llm.shared import stored


def _broadcast_rows(spark, known):
    """Rows of each table that was broadcast since the executions in `known`."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows = store.executionsList(), []
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        if run in known:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            for m in range(node.metrics().size()) if node.name() == "BroadcastExchange" else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return rows


def _known(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(k).executionId() for k in range(runs.size())}


def test_no_broadcast_outgrows_the_documents(spark):
    """A look-up under salted keys is sized by Spark before it is salted: only what needs it may be in it."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))) for _ in range(150)]
    rows = [(2 * k + j, t + f" end{j}") for k, t in enumerate(texts) for j in (0, 1)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "pairs")
    known = _known(spark)
    assert sorted(r.component_id for r in near_copies.near_keepers(docs).collect()) == [2 * k for k in range(150)]
    time.sleep(1)  # for the listener
    seen = _broadcast_rows(spark, known)
    assert seen and max(seen) <= len(rows)

    known = _known(spark)
    assert len(simhash.near_groups(docs).collect()) == len(rows)
    time.sleep(1)
    assert max(_broadcast_rows(spark, known), default=0) <= len(rows)


def test_small_tiles_and_blocks_give_the_same_groups(spark):
    """Cells and components of several parts, which are looked up, beside those of one, which are not."""
    rng = random.Random(6)
    rows = []
    for k in range(40):
        t = [f"w{rng.randrange(10**6)}" for _ in range(30 if k else 200)]
        for j in range(2 if k else 30):
            rows.append((len(rows), " ".join(t[:-1] + [f"end{j}"])))
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "groups")
    want = [0, *range(30, 108, 2)]
    for tile, block in ((1 << 12, 1 << 20), (4, 500)):
        assert sorted(r.component_id for r in near_copies.near_keepers(docs, tile=tile, block=block).collect()) == want
    wide = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect())
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_groups(docs, tile=3).collect()) == wide
