"""The machines of the transducer: their arcs and weights, the shortest path against all paths, decoding of many texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from turnstile.llm.piece_transducer import INFINITE, LEAF, MARK, NO_ARC, REST, Transducer, _Paths


@pytest.fixture(scope="module")
def machine():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return Transducer(f.read())


def test_lexicon_reads_each_piece_along_its_own_arcs(machine):
    for piece, i in machine.ids.items():
        state, written = machine.root, REST
        for char in piece:
            state, written = state[char]
        assert written == i
    arcs, todo = 0, [machine.root]
    while todo:
        state = todo.pop()
        arcs += len(state)
        todo += [after for after, _ in state.values() if after is not LEAF]
    assert arcs == len({piece[:k] for piece in machine.ids for k in range(1, len(piece) + 1)}) and LEAF == {}
    assert "\ue000" not in machine.ids and machine.root.get("\ue000", NO_ARC) == (LEAF, REST)


def every_path(machine, part):
    """(weight, ids) of every way through lexicon and grammar, without looking at weights on the way."""
    def go(start, last, weight):
        if start == len(part):
            yield weight, []
        for end in range(start + 1, len(part) + 1):
            i = machine.ids.get(part[start:end], REST if end == start + 1 else None)
            if i is not None:
                own = [i] if i != REST else [machine.bytes[b] for b in part[start:end].encode()]
                for total, ids in go(end, i, weight + machine.rows[last][i]):
                    yield total, own + ids

    return go(0, REST, 0.0)


def test_one_path_of_finite_weight_and_it_is_taken(machine):
    draw = random.Random(7)
    for _ in range(300):
        part = MARK + "".join(draw.choice("theinrsoaé,\U0001f600\ue000") for _ in range(draw.randrange(9)))
        finite = [ids for weight, ids in every_path(machine, part) if weight < INFINITE]
        assert finite == [machine.path(part)]


def test_decoding_many_texts_at_once(machine):
    texts = ["", " ", "a  b", "中\U0001f600", "", " lead", "tail ", "\n\t"]
    ids = [[i for part in machine.parts.findall(machine.normalised(t)) for i in machine.path(part)] for t in texts]
    ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    assert machine.decoded(ends, np.array(sum(ids, []), "<i4")).to_pylist() == texts
    assert machine.decode(np.array([machine.bytes[0xC3]], "<i4")) == "�" and machine.decode(np.array([], "<i4")) == ""


def test_full_cache_keeps_words_in_use(machine):
    paths = _Paths(machine)
    paths.FULL = 3
    for part in ["▁a", "▁b", "▁c", "▁d", "▁a", "▁e", "▁f", "▁a"]:
        assert np.frombuffer(paths[part], "<i4").tolist() == machine.path(part)
    assert len(paths) <= 3 and "▁a" in {**paths.older, **paths}
