import numpy as np

from roomledger.llm import jaccard_join as J
from roomledger.llm.hashing import mix


def test_prefix_is_the_start_of_the_whole_order():
    """Frequencies are looked up once for all orders, and only the prefix is sorted (before, all of a set for each order)."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 5_000, np.uint64) * np.uint64(2) + np.uint64(1))
    hashes = np.unique((pool[::3] >> np.uint64(32)).astype(np.uint32))
    for hot in ((hashes, rng.integers(64, 90, len(hashes))), (hashes[:0], np.empty(0, np.int64))):
        known = dict(zip(hot[0].tolist(), hot[1].tolist()))
        for n, some in ((1, pool), (40, pool), (300, pool), (40, pool[::3])):
            tokens = np.unique(rng.choice(some, n))
            count = J.counts_of(tokens, hot)
            assert count.tolist() == [known.get(t >> 32, 0) for t in tokens.tolist()]
            p = J.prefix_size(len(tokens), 85)
            for j in range(J.ORDERS):
                whole = tokens[np.lexsort((mix(tokens ^ J.SEEDS[j]), count))]
                assert J.ordered(tokens, j, count, p).tolist() == whole[:p].tolist()
