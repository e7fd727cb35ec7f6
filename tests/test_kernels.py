import numpy as np
import pytest

from trapline.config import Background, Postprocess
from trapline.operators.kernels import images, masks
from trapline.operators.kernels.background import Mixture, SampleBank, foreground


def grid(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


def test_morphology():
    one = grid("..... ..... ..#.. ..... .....")
    assert masks.dilate(one).sum() == 5 and masks.erode(masks.dilate(one)).sum() == 1
    assert masks.erode(np.ones((3, 3), bool)).all()
    assert not masks.median(one, 3).any() and masks.median(one, 2).sum() == 1
    assert masks.median(np.ones((4, 4), bool), 3).all()


def test_components_touch_by_corners():
    m = grid("#..# .#.. ...# ....")
    labels, stats = masks.components(m)
    assert stats[:, 0].tolist() == [2, 1, 1] and labels[0, 0] == labels[1, 1] == 1
    assert masks.filtered(m, 2, 0).sum() == 2 and not masks.filtered(m, 3, 0).any()
    assert masks.filtered(m, 0, 2).sum() == 3 and masks.filtered(m, 0, 0) is m
    # of two components with one pixel, the one found first stays
    assert masks.filtered(m, 0, 2)[0, 3] and not masks.filtered(m, 0, 2)[2, 3]


def test_spiral_is_one_component():
    m = grid("######## #......# #.####.# #.#..#.# #.#.##.# #.#....# #.###### #.......")
    assert masks.label(m)[1] == 1


def test_boxes():
    m = np.zeros((20, 30), bool)
    m[5:9, 10:16] = True
    assert masks.boxes(m, 1, 3, 1.0, 0) == [(10, 5, 16, 9)]
    assert masks.boxes(m, 1, 3, 2.0, 1) == [(6, 2, 20, 12)]
    assert masks.boxes(m, 25, 3, 1.0, 0) == [] and masks.boxes(np.zeros((4, 4), bool), 0, 0, 1.0, 0) == []


def test_sample_bank():
    rng = np.random.default_rng(0)
    base = rng.integers(90, 110, (40, 40)).astype(np.uint8)
    bank = SampleBank(Background(), 0, "v")
    assert not bank.apply(base).any()
    moved = base.copy()
    moved[10:20, 10:20] = 220
    fg = bank.apply(moved)
    assert fg[10:20, 10:20].all() and fg.sum() <= 110
    again = SampleBank(Background(), 0, "v")
    again.apply(base)
    assert np.array_equal(again.apply(moved), fg) and np.array_equal(again.bank, bank.bank)
    with pytest.raises(ValueError):
        bank.apply(base.astype(float))


def test_update_rate():
    bank = SampleBank(Background(subsampling_factor=16), 1, 7)
    flat = np.full((200, 200), 100, np.uint8)
    bank.apply(flat)
    bank.apply(np.full((200, 200), 105, np.uint8))
    share = (bank.bank == 105).sum() / flat.size
    # each chosen pixel writes one sample of its own and one of a neighbour
    assert 0.8 * 2 / 16 < share < 2 / 16 * 1.05


def test_adaptive_settings():
    b = SampleBank(Background(adaptive_min_matches=True, adaptive_update=True))
    b.intensity, b.motion = 100.0, 0.0
    assert b.matches_needed() == 2 and b.period() == 8
    b.intensity, b.motion = 500.0, 1.0
    assert b.matches_needed() == 4 and b.period() == 64
    assert SampleBank(Background(adaptive_min_matches=True, intensity_min=9, intensity_max=9)).matches_needed() == 2


def test_mixture():
    m = Mixture(history=50, shadows=True)
    flat = np.full((8, 8), 120, np.uint8)
    for _ in range(30):
        out = m.apply(flat)
    assert not foreground(out).any()
    bright, dim = flat.copy(), flat.copy()
    bright[2:4, 2:4], dim[2:4, 2:4] = 250, 80
    assert foreground(m.apply(bright)).sum() == 4
    out = m.apply(dim)
    assert (out[2:4, 2:4] == 127).all() and not foreground(out).any() and foreground(out, keep=True, threshold=100).sum() == 4


def test_images():
    g = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert images.resized(g, None) is g and images.resized(g, 4) is g
    assert images.resized(g, 2).tolist() == [[2, 4], [10, 12]]
    assert images.gray(np.full((2, 2, 3), 77, np.uint8)).tolist() == [[77, 77]] * 2
    x = images.normalised(np.full((5, 7, 3), 255, np.uint8), 4, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5))
    assert x.shape == (3, 4, 4) and np.allclose(x, 1.0)


def test_postprocess_order():
    m = grid("....... ..###.. ..###.. ..###.. .......")
    assert masks.cleaned(m, Postprocess(median_blur_ksize=1, erode_iters=1, dilate_iters=1)).sum() == 5
