"""Properties on generated inputs."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from civictally.operators.layout import squarify
from civictally.operators.limits import fixed_window
from civictally.operators.quality import check_document
from civictally.operators.structural import index_records
from test_problems import brute

LINES = st.lists(st.text(alphabet='",\r\nab é', max_size=12), max_size=8)


@given(LINES)
@settings(max_examples=400, deadline=None)
def test_index_records(lines):
    raw = [x.encode() for x in lines]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = ends - np.array([len(r) for r in raw], np.int64)
    stop = ends - np.array([r.endswith(b"\r") for r in raw], np.int64)
    ok, counts, values, offsets, _ = index_records(data, starts, stop)
    at = 0
    for line, good, n in zip(lines, ok, counts):
        want = brute(line)
        assert good == (want != "quoting")
        if good:
            assert [values[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(at, at + n)] == want
        at += n


@given(st.lists(st.floats(0.01, 1e7), min_size=1, max_size=30), st.floats(10, 2000), st.floats(10, 2000))
@settings(max_examples=200, deadline=None)
def test_squarify_fills_the_rectangle(values, w, h):
    values = sorted(values, reverse=True)
    scale = w * h / math.fsum(values)
    tiles = squarify([v * scale for v in values], w, h)
    assert math.isclose(sum(a * b for *_, a, b in tiles), w * h, rel_tol=1e-6)
    for x, y, a, b in tiles:
        assert x > -1e-6 * w and y > -1e-6 * h and x + a < w * (1 + 1e-6) and y + b < h * (1 + 1e-6)


@given(st.lists(st.integers(0, 200), max_size=60), st.integers(1, 50), st.integers(0, 60))
@settings(deadline=None)
def test_windows_do_not_depend_on_batches(times, window, cut):
    times = np.array(sorted(times), np.int64)
    whole, *_ = fixed_window(times, None, 0, window)
    one, start, count = fixed_window(times[:cut], None, 0, window)
    two, *_ = fixed_window(times[cut:], start, count, window)
    assert list(whole) == [*one, *two]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3))


@given(JSON)
@settings(deadline=None)
def test_any_document_fits_an_open_schema_and_one_of_its_own_kind(document):
    assert check_document(document, {}) == []
    kinds = [k for k in ("object", "array", "string", "integer", "boolean", "null") if check_document(document, {"type": k}) == []]
    assert len(kinds) == 1
