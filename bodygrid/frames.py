"""Frame registry and the integer cell line.

Every canonical address is given one interval ``[lo, lo + width)`` on a single
BIGINT line shared by all frames, so containment, roll-up and measure are exact
integer arithmetic that hashes identically on any partitioning:

* BD: 32 levels, each ``24 * 8^12`` wide (24 azimuth halves, then octal digits);
* BV: 2 hemispheres, each ``8^12`` wide, after the BD block;
* BR: 2 hemispheres of 12 base faces, each ``16^6`` wide, after the BV block.

All widths are powers of two apart from a BD level, whose offset is a multiple
of its own width, so the ancestor of ``lo`` at width ``w`` is ``lo - lo % w``.
``cell_key = lo * 16 + rung`` names a cell in one BIGINT: the join key
of every hierarchical join in this package.
"""

# The address grammar.
CANONICAL_LEVELS = (
    [f"C{i:02d}" for i in range(1, 8)]
    + [f"T{i:02d}" for i in range(1, 13)]
    + [f"L{i:02d}" for i in range(1, 6)]
    + [f"S{i:02d}" for i in range(1, 6)]
)
ANOMALOUS_LEVELS = ["T13", "L06", "S06"]
LEVELS = CANONICAL_LEVELS + ANOMALOUS_LEVELS
ENABLED_FRAMES = ["BD", "BV"]
MAX_DIGITS = {"BD": 12, "BV": 12, "BR": 7}
MIN_DIGITS = {"BD": 0, "BV": 0, "BR": 1}
ANCHOR_SEGMENTS = {"BD": 2, "BV": 1, "BR": 1}
DIGIT_CLASS = {"BD": "[0-7]", "BV": "[0-7]", "BR": "[0-9A-F]"}
BRANCHING = {"BD level": 24, "BD": 8, "BV": 8, "BR": 16}
CHECK_ALPHABET = "0123456789ABCDEFILORSTV-"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
FRAME_SUMMARY = {
    "BD": "Body, anchored to the vertebral column: level, clock azimuth, normalised depth.",
    "BV": "Brain volume in AC-PC proportional coordinates, covering cortex and deep structures alike.",
    "BR": "Cortical surface, indexed on the hemisphere registration sphere. Experimental in v1.",
}
CORTICAL_AREA_MM2 = 90000

# The line.
OCT12 = 1 << 36
BD_LEVEL_WIDTH = 24 * OCT12
BV_START = 32 * BD_LEVEL_WIDTH
BR_START = BV_START + 2 * OCT12
FACE_WIDTH = 1 << 24
MAX_RUNG = 13
