import pytest

import brute
from steplake.llm.jaccard_join import jaccard_links
from test_llm_text_operators import frame, near_copies


@pytest.mark.parametrize("seed,size,percent", [(1, 3, 90), (2, 5, 80)])
def test_all_links_are_listed(spark, seed, size, percent):
    docs = near_copies(seed, 100, 40) | {1000: None, 1001: "", 1003: "one two", 1004: "ONE  two"}
    members, links = jaccard_links(frame(spark, docs), size, percent)
    of = {r.doc_id: r["class"] for r in members.collect()}
    pairs = [(r.a, r.b) for r in links.collect()]
    linked = set(pairs)
    assert len(pairs) == len(linked) and all(a < b for a, b in linked) and set(of) == set(docs)
    got = {(a, b) for a in docs for b in docs if a < b and of[a] is not None
           and (of[a] == of[b] or of[b] is not None and (min(of[a], of[b]), max(of[a], of[b])) in linked)}
    sets = {d: brute.shingles(t, size) for d, t in docs.items()}
    assert got == {(a, b) for a in docs for b in docs if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
