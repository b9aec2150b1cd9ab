from graphloom.llm import flac


def test_frame_numbers_against_the_format():
    want = {0: "00", 127: "7f", 128: "c280", 191: "c2bf", 192: "c380", 2047: "dfbf", 2048: "e0a080", 65535: "efbfbf", 65536: "f0908080"}
    assert {n: flac._number(n).hex() for n in want} == want
    assert len(set(flac._headers(0, 3_000))) == 3_000
    assert flac._header(130)[4:6] == b"\xc2\x82"
