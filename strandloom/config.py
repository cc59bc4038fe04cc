"""Constants of the engine.

Fixed values, equal to those of the tools whose results are matched.
"""

from __future__ import annotations

SCALE = 100_000_000_000

TRUNCATION_THRESHOLD = 0.5
TRUNCATION_RECOVERY_THRESHOLD = 0.5
RETENTION_RATIO_THRESHOLD = 0.001
INTRON_FREQUENCY_RECOVERY_THRESHOLD = 0.5
SPLICE_AI_SCORE_RECOVERY_THRESHOLD = 0.01
MAX_ENT_SCORE_RECOVERY_THRESHOLD = 1.5
FUSION_RATIO_THRESHOLD = 0.5
INTRAPRIMING_RATIO_THRESHOLD = 0.5

REVIEW_RGB = "222,166,62"
STRONG_NMD_RGB = "125,40,40"
WEAK_NMD_RGB = "213,67,67"

CHUNK_SIZE = 500
MAX_CLIP5 = 20
MAX_CLIP3 = 20
POLYA_SUFFIX = 30
SUFFIX_STEP_SIZE = 50
IDENTITY_THRESHOLD = 98.0
MINIMUM_IDENTITY = 60.0
P2P = 0.9
EMIT_A = 0.99
POLYA_LENGTH_THRESHOLD = 50
GENOMIC_POLYA_THRESHOLD = 5
APARENT_THRESHOLD = 0.01
WIGGLE = 2
EXPANSION_SIZE = 150

NMD_DISTANCE = 55
WEAK_NMD_DISTANCE = 80
ATG_DISTANCE = 100
BIG_EXON_DIST_TO_EJ = 400

RT_WINDOW = 8
RT_CONTEXT = 12
RT_MISMATCH = 1
WIGGLE_SWITCH = (2, 4)
PEAK_HEIGHT, PEAK_DISTANCE, PEAK_PROMINENCE = 0.01, 50, 0.01
NAG_PATTERNS = ("CAG", "TAG", "AAG")

# base frequencies (A, C, G, T): background, first and second consensus position of an acceptor
BGD = {"A": 0.27, "C": 0.23, "G": 0.23, "T": 0.27}
CONS1 = {"A": 0.9903, "C": 0.0032, "G": 0.0034, "T": 0.0030}
CONS2 = {"A": 0.0027, "C": 0.0037, "G": 0.9905, "T": 0.0030}

BIG_SEP, SEP = "__", "#"
