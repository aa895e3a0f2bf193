"""Operators on what an earlier version cut or could not read."""

import numpy as np
import public_tokenizers
import pytest

from urbanweave.llm import html_template, language_id, packing


def vocabulary():
    return language_id.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def spelled(v):
    """Piece ids by bytes, read from the file again."""
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        pieces = {base64.b64decode(x.split()[0]).lower() for x in f if x.strip()} | {bytes([b]) for b in range(256)}
    key = lambda p: (len(p) << 56) | int.from_bytes(p, "big") if len(p) <= language_id.PIECE_BYTES else language_id._long_key(p, v.base)
    at = {int(k): i for i, k in enumerate(v.keys)}
    return {p: at[key(p)] for p in pieces}


def plain_log(word, ids, p):
    log = [0.0]
    for i in range(1, len(word) + 1):
        terms = [log[i - n] + np.log(p[ids[word[i - n : i]]]) for n in range(1, min(i, 40) + 1) if word[i - n : i] in ids]
        top = max(terms)
        log.append(top + np.log(sum(np.exp(t - top) for t in terms)))
    return log[-1]


@pytest.mark.parametrize("word", [b"international", b"responsibilities" * 5, "ประเทศไทยมีประชากร".encode() * 2, ("環境測定" * 40).encode(), b"z" + b"communication" * 60])
def test_words_of_any_length_are_summed_whole(word):
    v = vocabulary()
    ids = spelled(v)
    assert len(ids) == len(v.keys) and max(map(len, ids)) > 7
    p = np.append(np.random.default_rng(1).random(len(v.keys)) / len(v.keys), 0.0)
    got = language_id.word_scores(v, p[:, None], np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0, 0]
    assert got == pytest.approx(plain_log(b" " + word, ids, p), rel=1e-9)


def test_long_words_score_alike_on_both_paths_and_teach(monkeypatch):
    v = vocabulary()
    words = {("ประเทศไทยมีประชากรจำนวนมาก" * k).encode(): k for k in (1, 2, 3)}
    assert min(map(len, words)) > 64
    batch = language_id.fit(v, words, rounds=2)
    monkeypatch.setattr(language_id, "BATCH_BYTES", 0)
    monkeypatch.setattr(language_id, "BLOCK", 50)
    single = language_id.fit(v, words, rounds=2)
    assert single == pytest.approx(batch, abs=1e-12)
    assert batch.max() > 100 / len(v.keys)


@pytest.mark.parametrize("run", [" " * 1_100_000, "\n" * 1_500_000])
def test_very_long_white_space_has_the_ids_of_the_library(run):
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = "before" + run + "behind"
    with pytest.raises(ValueError):
        tokens.fast.encode_to_numpy(text, disallowed_special=())
    assert tokens.ids(text).tolist() == tokens.plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("tag", ["article class='post has-sidebar'", "article class='sidebar'", "div id='content' class='with-sidebar comments-open'", "div role='main' class='sidebar'"])
def test_names_of_modifiers_set_no_article_apart(tag):
    page = f"<body><{tag}><p>One two.</p><div class='comments'><p>no</p></div></{tag.split()[0]}><div class='sidebar'>side</div></body>"
    assert html_template.main_text(page, None) == "One two."
