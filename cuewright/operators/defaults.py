"""Default tables of ASS documents; fixed values."""

from __future__ import annotations

STYLE = [
    ("Name", "Default"), ("Fontname", "Arial"), ("Fontsize", "48"), ("PrimaryColour", "&H00FFFFFF"), ("SecondaryColour", "&H000000FF"), ("OutlineColour", "&H00000000"), ("BackColour", "&H00000000"),
    ("Bold", "0"), ("Italic", "0"), ("Underline", "0"), ("StrikeOut", "0"), ("ScaleX", "100"), ("ScaleY", "100"), ("Spacing", "0"), ("Angle", "0"), ("BorderStyle", "1"), ("Outline", "2"), ("Shadow", "0"),
    ("Alignment", "2"), ("MarginL", "10"), ("MarginR", "10"), ("MarginV", "10"), ("Encoding", "1"),
]
STYLE_FORMAT = [k for k, _ in STYLE]
EVENT_FORMAT = ["Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text"]
