"""Piece lookups go no further than the vocabulary's prefixes; a batch without words has rows."""

import numpy as np

from riskloom.llm import segment as S


def test_lookups_stop_at_the_last_prefix(monkeypatch):
    vocab = S.lattice_of(S.model_path()).vocab
    text = S.MARK + "qxzvjw" * 8 + S.MARK + "international"
    chars = S.to_chars(text)
    sums, pieces = vocab.prefix_sums(chars), set()
    looked, at = 0, np.arange(len(chars))
    for k in range(1, vocab.longest + 1):
        at = at[at <= len(chars) - k]
        looked += len(at)
        here, j, at = vocab.pieces(sums, at, k)
        pieces |= {(int(i), k, int(vocab.ids[n])) for i, n in zip(here, j)}
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    assert pieces == {(i, k, known[text[i:i + k]]) for i in range(len(text)) for k in range(1, vocab.longest + 1)
                      if i + k <= len(text) and text[i:i + k] in known}
    assert looked < len(chars) * vocab.longest / 3      # every place by every length before


def test_batch_without_words():
    lattice = S.Lattice(S.Vocabulary(S.model_path()))
    rows = list(S.segmentations(lattice, [1, None], ["", ""], 2))
    assert [(d, r, len(x)) for d, r, x, *_ in rows] == [(1, 1, 0), (None, 1, 0)]
