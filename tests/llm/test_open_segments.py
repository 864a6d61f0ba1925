"""op4: which strings of open segments are sorted."""

import numpy as np
import pyarrow as pa
import zstandard

from seqfold.llm import suffix_dedup as sd

RNG = np.random.default_rng(17)


def letters(n):
    return RNG.integers(97, 123, n).astype(np.uint8).tobytes()


def test_only_strings_that_may_be_equal_are_sorted(monkeypatch):
    phrase, passage = letters(60), letters(90)
    texts = [letters(300) + phrase + (passage if k < 2 else b"") + letters(300) for k in range(40)]
    found = np.concatenate([sd.segments(t, [(k, 0, len(t), 0)]) for k, t in enumerate(texts)])
    first, settled = sd.settle(found)
    pieces = [texts[d][s : s + n + 99] for d, s, n in first[["doc", "start", "n"]].tolist()]
    head, sizes, whole = sd.pack(first), [], sd.later_strings
    data = len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor().compress(b"".join(pieces))
    monkeypatch.setattr(sd, "later_strings", lambda ps, *rest: (sizes.append(sum(map(len, ps))), whole(ps, *rest))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sd.OPEN], pa.int32()), pa.array([data], pa.binary())], schema=sd.PARTS)
    sent = [sd.unpack(x, sd.RANGE) for b in sd._sort(1, 100)(iter([batch])) for x in b.column("data").to_pylist()]
    ranges = np.concatenate([sd.ranges(settled), *sent])
    seen = set()
    for k, t in enumerate(texts):
        want = [s for s in range(len(t) - 99) if t[s : s + 100] in seen]
        seen |= {t[s : s + 100] for s in range(len(t) - 99)}
        r = ranges[ranges["doc"] == k]
        assert sorted(s for a, n in r[["start", "n"]].tolist() for s in range(a, a + n)) == want
        assert (k == 1) == bool(want)
    assert 0 < sum(sizes) < 0.05 * sum(map(len, pieces))
