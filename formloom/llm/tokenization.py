"""Public tokenizers inside tasks: the libraries' own results, faster on long tables.

Where a byte-level vocabulary is ranked, a text of plain Latin letters and blanks goes
as a whole through a faster merge loop with the same word pattern.  Other texts are
cut where the tokenizer is known to cut (at white space), and each
distinct chunk is encoded once for each task.  A chunk of plain Latin letters goes
straight to the library's merge model; any other chunk goes through the whole
library pipeline, as does any text with separators on which Python and the
library differ.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: Chunks remembered in one task before the memory is given back.
CHUNK_CACHE = 60_000
#: Characters that normalisation leaves alone (but for case) in any Unicode version.
_PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ]*")
_PLAIN_TEXT = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The merge loop's word pattern keeps a stack for runs of blanks; longer ones go to the library.
_LONG_BLANKS = re.compile("[\t\n\r ]{4096}")
#: Python takes these as white space, the library does not.
_ODD = re.compile("[\x1c-\x1f]")
_WITH_BLANKS, _WITHOUT_BLANKS = re.compile(r"\s*\S+|\s+"), re.compile(r"\S+")
# The word patterns of the two tokenizer families, over plain characters
# (the first also with blanks, as the merge loop takes it).
_BYTE_TEXT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-zÀ-ÖØ-öø-ÿ0-9]+| +(?![^ ])| +"
)
_LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable Latin-1
    stands for itself, the rest follow from code point 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _by_rank(model: dict, letters: dict[int, str]) -> Callable[[str], list[int]] | None:
    """An encoder for byte-level vocabularies whose ids are the merges' ranks: then
    tiktoken's merge loop gives the same ids, in less time.  None for others."""
    vocab, merges = model["vocab"], model["merges"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if model.get("ignore_merges") or any(vocab.get(w) != 256 + i for i, w in enumerate(joined)):
        return None
    import tiktoken

    octets = {c: b for b, c in letters.items()}
    ranks = {bytes([octets[c] for c in w]): i for w, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding(
        "ranked", pat_str=_BYTE_TEXT, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def json_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them, without added special tokens."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def whole(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, kinds = told.get("pre_tokenizer") or {}, [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
    special = re.compile("|".join(re.escape(t["content"]) for t in told.get("added_tokens", [])) or r"(?!)")
    lower = kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kinds:
        cut, inner = _WITH_BLANKS, _BYTE_WORDS
    elif lower:
        cut, inner = _WITHOUT_BLANKS, _LOWER_WORDS
    else:
        return whole
    letters, model, chunks, parts = byte_letters(), library.model, {}, {}
    ranked = None if lower else _by_rank(told["model"], letters)

    def chunk_ids(chunk: str) -> list[int]:
        if not _PLAIN.fullmatch(chunk) or special.search(chunk) or _LONG_BLANKS.search(chunk):
            return whole(chunk)
        if ranked:
            return ranked(chunk)
        out: list[int] = []
        for word in inner.findall(chunk.lower() if lower else chunk):
            ids = parts.get(word)
            if ids is None:
                written = "".join([letters[b] for b in word.encode()])
                ids = parts[word] = [t.id for t in model.tokenize(written)]
            out += ids
        return out

    def encode(text: str) -> list[int]:
        if ranked and _PLAIN_TEXT.fullmatch(text) and not special.search(text) and not _LONG_BLANKS.search(text):
            return ranked(text)
        if _ODD.search(text):
            return whole(text)
        if len(chunks) > CHUNK_CACHE:
            chunks.clear()
            parts.clear()
        out: list[int] = []
        for chunk in cut.findall(text):
            ids = chunks.get(chunk)
            if ids is None:
                ids = chunks[chunk] = chunk_ids(chunk)
            out += ids
        return out

    return encode


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer at ``path``: .json or .model."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: pieces.encode(text, num_threads=1)
    return json_encoder(path)


