"""Token ids of whole texts."""

from __future__ import annotations

#: A text that holds this string takes the slower library, which maps it to one id.
SPECIAL = "<|endoftext|>"


def tokenizer_files(json_path: str | None = None, ranks_path: str | None = None) -> tuple[str, str | None]:
    """The vocabulary's two files: for the ``tokenizers`` library and, for speed,
    the same vocabulary as ranks. Without arguments: the installed 50k byte-level BPE."""
    if json_path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return json_path, ranks_path


def make_encoder(json_path: str, ranks_path: str | None):
    """text -> list of ids, equal to ``Tokenizer.encode(add_special_tokens=False)``.

    The rank file gives the same ids about five times as fast (a test compares them).
    """
    state: dict = {}

    def slow(text):
        if "slow" not in state:
            from tokenizers import Tokenizer

            state["slow"] = Tokenizer.from_file(json_path)
        return state["slow"].encode(text, add_special_tokens=False).ids

    if not ranks_path:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow(text) if SPECIAL in text else fast.encode_ordinary(text)
