"""Near-duplicates in buckets whose first hub is some other text."""

import numpy as np

from tests.llm.test_ops import five, labels_of, plain_components


def test_all_pairs_of_a_bucket_are_linked_or_compared(make):
    rng = np.random.default_rng(9)
    # texts of one template, less than 0.8 alike, each with a near copy: in most samples some other text is the hub
    template, rows = [f"t{x}" for x in range(300)], []
    for k in range(40):
        own, n = [f"w{k}x{x}" for x in range(12)], int(rng.integers(34, 38))
        rows += [(2 * k + c, " ".join([*template, *own, *(f"v{k}x{x}x{c}" for x in range(n))]), "s") for c in (0, 1)]
    shingles = {i: five(t) for i, t, _ in rows}
    ids = list(shingles)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert pairs == [(2 * k, 2 * k + 1) for k in range(40)]
    got, first = labels_of(make, rows), {}
    for i in ids:
        first.setdefault(got[i], i)
    assert {i: first[got[i]] for i in ids} == plain_components(pairs)


def test_probes_of_a_part_do_not_grow_with_the_table():
    import numpy as np

    from tallyloom.llm import ann

    for n in (2_000, 10**5, 10**7, 10**9, 10**11):
        parts = max(ann.LEAST_PARTS, int(np.ceil(np.sqrt(n / ann.CELL_ROWS))))
        rows = min(n, max(ann.SAMPLE, ann.EACH * parts) * parts)
        for share in (0.02, 0.3, 0.9):
            visits = max(1.0, share * parts)
            probes = rows * ann.probe_share(rows, parts, visits)
            assert probes * visits / parts <= 2 * ann.PROBES * 1.01  # rows of a task's group that are probes
            assert probes >= min(0.1 * rows, ann.PROBES)
