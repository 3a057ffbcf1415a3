"""How many links between near copies the trees find, by the size of the group, among documents that share a passage with hundreds of others."""

import random

from mnemospark.llm import near_dedup

TEMPLATES, ALONE = 2, 150
GROUPS = {2: 30, 5: 12, 20: 4, 60: 1}


def _corpus():
    """(doc_id, text), and the groups (size, doc_ids): a first text and others that differ from it in one word or two."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(50_000)}"
    rows, groups = [], []
    for _ in range(TEMPLATES):
        passage = [word() for _ in range(60)]
        for _ in range(ALONE):
            rows.append(" ".join(passage + [word() for _ in range(60)]))
        for size, times in GROUPS.items():
            for _ in range(times):
                base = passage + [word() for _ in range(60)]
                first = len(rows)
                rows.append(" ".join(base))
                for i in range(1, size):
                    other = list(base)
                    for at in rng.sample(range(4, 116, 8), 1 + i % 2):
                        other[at] = word()
                    rows.append(" ".join(other))
                groups.append((size, range(first, len(rows))))
    return list(enumerate(rows)), groups


def _links(rows, ids):
    """The pairs of a group that are links, by their whole sets."""
    sets = {}
    for i in ids:
        w = rows[i][1].split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    return [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_recall_by_group_size(spark, monkeypatch):
    rows, groups = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    # the same without the comparison of groups that stay large: what the trees alone find
    none = lambda docs, *_: docs.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_dedup, "_compare_whole", none)
    trees = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    for size in GROUPS:
        links = [x for n, ids in groups if n == size for x in _links(rows, ids)]
        assert len(links) >= (size - 1) * GROUPS[size] * TEMPLATES
        recall = [sum(found[a] == found[b] for a, b in links) / len(links) for found in (trees, whole)]
        assert recall[0] >= 0.9 and recall[1] >= 0.99, (size, recall)
    own = {i: min(ids) for _, ids in groups for i in ids}
    for found in (trees, whole):  # and nothing that isn't a near copy is joined
        assert all(found[i] in (i, own.get(i, i)) or found[i] in own and own[found[i]] == own.get(i) for i in found)
