"""Targets per source in plain Python."""

from discframe.llm.mixing import WEIGHTS, water_fill


def words_of_source(rows):
    """Per source its target and the words of its smallest document (how near a mix may miss)."""
    sizes = {}
    for r in rows:
        sizes.setdefault(r["source"], []).append(len(r["text"].split()))
    names = sorted(sizes, key=lambda s: (s is None, s))
    totals = [sum(sizes[s]) for s in names]
    targets = water_fill(totals, [WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(totals), 2)
    return {s: (t, max(5, min(sizes[s]))) for s, t in zip(names, targets)}

