"""What a proof yields must follow from it, for changed and unchanged rows alike."""

import pandas as pd

from themeloom.llm import merkle


def expanded(sibling):
    leaves = [merkle.H([str(i)]) for i in range(8)]
    subroot = merkle.H(leaves)
    own = pd.DataFrame({"_k": "+en", "_pos": [2, 3], "_n": 8, "_j": 0, "_h": leaves[2:4], "_t": [leaves[2], "0" * 64], "_row": [0, 1]})
    known = {(0, 0, "+en", i): leaves[i] for i in (0, 1, 4, 5, 6, 7)}
    known |= {(0, 1, "+en", 0): subroot, (1, 0, "", 0): subroot}
    if sibling is not None:
        known[(0, 0, "+en", 5)] = sibling
    return subroot, merkle._expand(own, known, 1).sort_values("_row")["folded_root"].tolist()


def test_folded_root_follows_from_the_proof():
    root, (kept, tampered) = expanded(None)
    assert kept == root and tampered != root
    # a wrong sibling shows on a row whose own leaf is as it was
    root, (kept, _) = expanded("f" * 64)
    assert kept != root
