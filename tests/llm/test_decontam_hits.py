"""Windows found in documents are neither shuffled nor made distinct with what fills them."""

from emberwatch.llm import decontam
from test_decontam import ITEM, MIXED, OTHER, PROSE, docs, items


def test_hits_take_no_shuffle(spark, monkeypatch):
    plans = []

    def staged(df, label, of=decontam.staged):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return of(df, label)

    monkeypatch.setattr(decontam, "staged", staged)
    texts = [f"{PROSE} {ITEM} {PROSE}", f"{PROSE} {OTHER}", PROSE, MIXED, f"{MIXED} {ITEM}", None, ""]
    once, bench = docs(spark, texts), items(spark, [ITEM, MIXED, "short one"])
    want = sorted(map(tuple, decontam.contaminated(once, bench).collect()))
    plan = dict(plans)["template-hits"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert len(want) >= 4
    twice = sorted(map(tuple, decontam.contaminated(once.union(once), bench.union(bench)).collect()))
    monkeypatch.setattr(decontam, "HELD", 0)
    assert twice == want == sorted(map(tuple, decontam.contaminated(once.union(once), bench.union(bench)).collect()))
