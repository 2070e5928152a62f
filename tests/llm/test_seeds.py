"""Every overlap that the comparison accepts has a seed, whichever of its tokens are substituted."""

from itertools import combinations
from math import ceil

import pytest

from wherescore.llm import decontaminate


def substitutions(width):
    """All ways to substitute as many of ``width`` tokens as the comparison forgives."""
    return combinations(range(width), width - ceil(width * decontaminate.AGREE))


@pytest.mark.parametrize("width", range(decontaminate.SPAN, decontaminate.WINDOW + 1))
def test_masks_lose_no_overlap(width):
    ignored = [{i for i, bit in enumerate(m) if bit == "0"} for m in decontaminate.MASKS]
    spans = range(width - decontaminate.SPAN + 1)
    for places in substitutions(width):
        assert any({p - o for p in places if 0 <= p - o < decontaminate.SPAN} <= skip for o in spans for skip in ignored)


def test_substituted_items_are_found(spark):
    docs, items, wanted = [], [], set()
    for width in (8, 10, 11, 16):
        words = [f"w{width}x{i}" for i in range(width)]
        items.append((width, " ".join(words)))
        for n, places in enumerate(substitutions(width)):
            changed = ["other" if i in places else w for i, w in enumerate(words)]
            docs.append((width * 1000 + n, f"before {' '.join(changed)} after"))
            wanted.add((width * 1000 + n, width))
        changed = ["other" if i in places or i == places[0] - 1 else w for i, w in enumerate(words)]
        docs.append((width * 1000 + 999, " ".join(changed)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, i) for r in found.collect() for i in r["items"]} == wanted
