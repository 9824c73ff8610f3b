"""Characters that end a sentence: Unicode's Sentence_Break properties STerm and ATerm, as code points in hexadecimal."""

_CODES = (
    "21 2e 3f 589 61d-61f 6d4 700-702 7f9 837 839 83d-83e 964-965 104a-104b 1362 1367-1368 166e 1735-1736 1803 1809 "
    "1944-1945 1aa8-1aab 1b5a-1b5b 1b5e-1b5f 1b7d-1b7e 1c3b-1c3c 1c7e-1c7f 2024 203c-203d 2047-2049 2e2e 2e3c "
    "2e53-2e54 3002 a4ff a60e-a60f a6f3 a6f7 a876-a877 a8ce-a8cf a92f a9c8-a9c9 aa5d-aa5f aaf0-aaf1 abeb fe12 "
    "fe15-fe16 fe52 fe56-fe57 ff01 ff0e ff1f ff61 10a56-10a57 10f55-10f59 10f86-10f89 11047-11048 110be-110c1 "
    "11141-11143 111c5-111c6 111cd 111de-111df 11238-11239 1123b-1123c 112a9 1144b-1144c 115c2-115c3 115c9-115d7 "
    "11641-11642 1173c-1173e 11944 11946 11a42-11a43 11a9b-11a9c 11c41-11c42 11ef7-11ef8 11f43-11f44 16a6e-16a6f "
    "16af5 16b37-16b38 16b44 16e98 1bc9f 1da88 "
)


def _expand(codes: str) -> str:
    out = []
    for part in codes.split():
        first, _, last = part.partition("-")
        out += map(chr, range(int(first, 16), int(last or first, 16) + 1))
    return "".join(out)


TERMINATORS = _expand(_CODES)
#: Characters that end a clause before white space.
CLAUSE_MARKS = ";,’：—)&…"
