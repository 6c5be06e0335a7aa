import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from cladeloom.llm.q_pieces import op8_sentencepiece
from cladeloom.llm.sentence_pieces import CharacterMap, Encoder, Rules, encode, normalise

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab ▁\néß日😀<s>.0\t"


def test_ids_spans_and_decoded_text_equal_the_library():
    mine, library, draw = Encoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(7)
    texts = ["", " ", "   a", "▁▁x", "<s></s> <unk> <0x41>", "\x00a", " " * 37 + "a  ", "a" * 3000, "x" * 70 + "é" * 70]
    texts += ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(30))) for _ in range(2000)]
    for text in texts:
        ids, begins, ends, decoded = mine.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == library.encode(text) and decoded == library.decode(ids.tolist()), repr(text)
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces], repr(text)


def test_normalisation_by_a_compiled_map_equals_the_library():
    from sentencepiece import sentencepiece_model_pb2

    draw = random.Random(9)
    for prefix, squeeze, escape in ((0, 0, 0), (1, 1, 1), (1, 0, 1), (0, 1, 0)):
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=bool(prefix), remove_extra_whitespaces=bool(squeeze), escape_whitespaces=bool(escape))
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(library.serialized_model_proto())
        rules = Rules(bool(prefix), bool(squeeze), bool(escape), CharacterMap(model.normalizer_spec.precompiled_charsmap))
        for _ in range(1500):
            text = "".join(draw.choice("ab  é́ﬁ㍿ｱﾞ \t\n½Å日😀①") for _ in range(draw.randrange(12)))
            normal, offsets = library.normalize(text, with_offsets=True)
            places = [0]
            for c in text:
                places.append(places[-1] + len(c.encode()))
            found, begins = normalise(text, rules)
            assert found == normal and begins.tolist() == [places[x] for x in offsets], repr(text)


def test_query_equals_the_library(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r.doc_id: r for r in op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for doc in documents.collect():
        ids = library.encode(doc.text, add_eos=True)
        r = rows[doc.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_unusual_rows(spark, frame, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = encode(frame(odd), PATH).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert list(r.encoded.ids) == library.encode(r.text or "", add_eos=True)
        raw = (r.text or "").encode()
        assert r.encoded.begins[-1] == r.encoded.ends[-1] == len(raw)
        assert b"".join(raw[a:b] for a, b in zip(r.encoded.begins, r.encoded.ends, strict=True)) == raw
    assert encode(frame([]), PATH).count() == 0


def test_decoding_of_any_ids():
    """Ids that no text gives: stray bytes, control ids, unknown ones, marks in a row."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = Encoder(PATH)
    draw = random.Random(12)
    marks = [i for i in range(library.vocab_size()) if set(library.id_to_piece(i)) == {"\u2581"}]
    pools = [list(encoder.bytes.values()), [0, 1, 2], marks or [5], range(library.vocab_size())]
    for _ in range(3000):
        ids = [draw.choice(draw.choice(pools)) for _ in range(draw.randrange(0, 9))]
        assert encoder.decode(np.array(ids, np.int32)) == library.decode(ids), ids
    for text in ("na\u00efve \u4f60\u597d \U0001f600 x", "  two  spaces ", "\u0301", "tab\tand\nline"):
        ids = library.encode(text)
        assert encoder.encode(text)[3] == encoder.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_worker_keeps_its_encoder_and_chunks_decode_apart():
    """Chunks that are remembered with their text: bytes on both sides of a chunk's border, marks alone, first and later."""
    from cladeloom.llm.sentence_pieces import encoder_of

    library, draw = sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(21)
    encoder = encoder_of(PATH)
    assert encoder_of(PATH) is encoder
    for _ in range(1500):
        text = "".join(draw.choice(["\U0001f600", "́", "\n", " ", "▁", "a", "word", "\x7f", "", "z" * 50]) for _ in range(draw.randrange(9)))
        ids, _, _, decoded = encoder.encode(text)
        assert ids.tolist() == library.encode(text) and decoded == library.decode(ids.tolist()), repr(text)
        for chunk in encoder.chunks.findall(text.replace(" ", "▁")):
            kept = encoder.known[chunk]
            assert encoder.decode(np.frombuffer(kept[0], "<i4"), first=False) == kept[2]


def test_words_are_remembered_without_their_stops():
    """A word with other stops behind it is not merged again, and stops that stand in other places keep their pieces."""
    library, encoder, draw = sentencepiece.SentencePieceProcessor(model_file=PATH), Encoder(PATH), random.Random(31)
    encoder.encode("Esjaque")
    merged = []
    encoder.known.compute = lambda chunk, f=encoder.chunk: merged.append(chunk) or f(chunk)
    encoder.encode("Esjaque. Esjaque, Esjaque; Esjaque!")
    assert not any("Esjaque" in chunk for chunk in merged)
    for _ in range(3000):
        text = "".join(draw.choice(["word", "É", "e.g", ".", ",", "...", '"', ")", "?!", "²", "'s", "日", " ", "▁", "\n", "7", "z" * 60]) for _ in range(draw.randrange(12)))
        ids, _, _, decoded = encoder.encode(text)
        assert ids.tolist() == library.encode(text) and decoded == library.decode(ids.tolist()), repr(text)
