"""What a Python worker holds at once."""

import tracemalloc

import numpy as np
import pytest

from winnow.llm import decontaminate, kit, quality, simhash


def _shingles(b, off):
    for i, j in kit.slices(off):
        simhash.shingle_sets(b[off[i] : off[j]], off[i : j + 1] - off[i], 5)


def _stats(b, off):
    for i, j in kit.slices(off):
        quality.text_stats(b[off[i] : off[j]], off[i : j + 1] - off[i])


@pytest.mark.parametrize("kernel", [decontaminate.term_hashes, _shingles, _stats])
def test_a_kernel_holds_little_more_than_its_texts(kernel):
    """Two workers stand beside an executor's JVM, so each may take some 64 MB for 4 MB of text, not 200."""
    r = np.random.default_rng(1)
    b = r.integers(97, 123, 4 << 20).astype(np.uint8)
    b[r.random(len(b)) < 1 / 6] = 0x20
    off = np.arange(0, len(b) + 1, 2048)
    kit._powers.clear()
    tracemalloc.start()
    kernel(b, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, f"{peak >> 20} MB"


def test_term_hashes_do_not_depend_on_slices(monkeypatch):
    texts = ["One two", "", " ", "three four-five 6 " * 40, "one", "", "Two ONE " * 30]
    b = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    whole, first = decontaminate.term_hashes(b, off)
    monkeypatch.setattr(decontaminate, "slices", lambda off: kit.slices(off, 64))
    parts, again = decontaminate.term_hashes(b, off)
    assert whole.tolist() == parts.tolist() and first.tolist() == again.tolist() == [0, 2, 2, 2, 162, 163, 163, 223]
    assert [len(x) for x in decontaminate.term_hashes(b[:0], np.zeros(1, np.int64))] == [0, 1]
