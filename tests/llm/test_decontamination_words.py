"""Items without room for an edit are found wherever they stand alone, also behind a hit within a longer word."""

from lumenlog.llm import decontamination as D


def test_later_hits_that_stand_alone():
    block = D.ItemBlock([(1, "Yes"), (2, "sea water"), (3, "no")], 0.1)
    text = "yesterday yesyes no_one seen under undersea waters noon: oh yes! the sea water is yes, and no"
    clean = D.normalise(text)
    hits = {h[0]: h[1:] for h in block.find(text)}
    assert hits == {1: (0, clean.index("yes!"), clean.index("yes!") + 3), 2: (0, clean.index("sea water is"), clean.index("sea water is") + 9), 3: (0, len(clean) - 2, len(clean))}
    assert block.find("yesterday eyes undersea waters noon") == []
    assert [h[0] for h in block.find("yes" * 5000 + "t yes")] == [1]
