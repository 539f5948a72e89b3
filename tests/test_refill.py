"""refill_budget against a loop over its rows."""

from lodestruct.plans import registry, sampling


def test_refill_budget(spark, sf):
    pool = sampling._sharded(spark, sf).collect()
    want = set()
    for shard in {r["shard"] for r in pool}:
        atoms, edges, n = 20, 0, 3
        for r in sorted((r for r in pool if r["shard"] == shard), key=lambda r: (-r["bin"], r["system_id"])):
            if atoms + r["num_atoms"] <= 64 and edges + r["num_edges"] <= 1000 and n + 1 <= 12:
                atoms, edges, n = atoms + r["num_atoms"], edges + r["num_edges"], n + 1
                want.add((shard, r["system_id"]))
    got = [tuple(r) for r in registry.queries()["refill_budget"](spark, sf).select("shard", "system_id").collect()]
    assert len(got) == len(want) and set(got) == want and want
