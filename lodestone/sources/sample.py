"""Model files with weights from a seed, for queries, timings and tests: no public weights are on this machine."""

from __future__ import annotations

import numpy as np

from lodestone.sources import gguf

#: Merges of the sample vocabulary; each is made of two pieces that come before it.
MERGES = [
    "th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur",
    "▁a", "▁t", "▁s", "▁w", "▁c", "▁d", "▁e", "▁l", "▁p", "▁i", "▁o", "▁in", "▁th", "the", "▁the", "ing", "and", "▁and", "ent", "ion", "tion", "her", "ere", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth", "hes", "ver", "his", "oft", "▁of", "▁to", "▁re", "▁de", "▁la", "▁le", "▁un", "ment", "▁is", "▁be",
]
CHARACTERS = "▁ " + "".join(chr(c) for c in range(0x21, 0x7F)) + "\n"
BOS, EOS, UNKNOWN, PAD = 2, 1, 3, 0


def vocabulary(merges: bool = True, size: int = 0) -> tuple[list[str], list[float], list[int]]:
    """(tokens, scores, types): specials, characters, the 256 bytes at their fixed place, merges, and filling up to ``size``."""
    tokens = ["<pad>", "<eos>", "<bos>", "<unk>", *CHARACTERS]
    types = [3, 3, 3, 2] + [1] * len(CHARACTERS)
    while len(tokens) < 238:
        types.append(5)
        tokens.append(f"<unused{len(tokens)}>")
    tokens += [f"<0x{b:02X}>" for b in range(256)]
    types += [6] * 256
    if merges:
        tokens += MERGES
        types += [1] * len(MERGES)
    while len(tokens) < size:
        types.append(5)
        tokens.append(f"<unused{len(tokens)}>")
    scores = [0.0] * len(tokens)
    for n, token in enumerate(MERGES if merges else ()):
        scores[494 + n] = -float(n + 1)
    return tokens, scores, types


def model(dim: int = 128, layers: int = 2, heads: int = 4, kv_heads: int = 2, inner: int = 192, longest: int = 2048, vocab: int = 0, seed: int = 1) -> bytes:
    """A file of an encoder of that shape."""
    rng = np.random.default_rng(seed)
    tokens, scores, types = vocabulary(size=vocab)
    p, head = "sample.", dim // heads
    numbers = {"embedding_length": dim, "block_count": layers, "attention.head_count": heads, "attention.head_count_kv": kv_heads, "feed_forward_length": inner, "context_length": longest}
    meta: dict[str, tuple[int, object]] = {"general.architecture": (8, "sample"), **{p + k: (4, v) for k, v in numbers.items()}, p + "attention.layer_norm_rms_epsilon": (6, 1e-6), p + "rope.freq_base": (6, 10000.0)}
    meta |= {"tokenizer.ggml.tokens": (9, (8, tokens)), "tokenizer.ggml.scores": (9, (6, scores)), "tokenizer.ggml.token_type": (9, (5, types))}
    meta |= {f"tokenizer.ggml.{n}_token_id": (4, i) for n, i in (("bos", BOS), ("eos", EOS), ("unknown", UNKNOWN), ("padding", PAD))}
    meta |= {"tokenizer.ggml.add_bos_token": (7, True), "tokenizer.ggml.add_eos_token": (7, True)}
    tensors: dict[str, tuple[int, tuple[int, ...], bytes]] = {}

    def matrix(name: str, out: int, width: int) -> None:
        blocks = np.zeros(out * width // 32, gguf.Q8_BLOCK)
        blocks["codes"] = rng.integers(-127, 128, (len(blocks), 32), np.int8)
        blocks["scale"] = width**-0.5 / 73  # about unit variance of the products
        tensors[name] = (8, (width, out), blocks.tobytes())

    def norm(name: str, n: int) -> None:
        tensors[name] = (0, (n,), (1 + 0.1 * rng.standard_normal(n)).astype("<f4").tobytes())

    matrix("token_embd.weight", len(tokens), dim)
    for i in range(layers):
        b = f"blk.{i}."
        for n, out, width in (("attn_q", dim, dim), ("attn_k", kv_heads * head, dim), ("attn_v", kv_heads * head, dim), ("attn_output", dim, dim), ("ffn_gate", inner, dim), ("ffn_up", inner, dim), ("ffn_down", dim, inner)):
            matrix(f"{b}{n}.weight", out, width)
        for n, size in (("attn_norm", dim), ("ffn_norm", dim), ("attn_q_norm", head), ("attn_k_norm", head), ("post_attention_norm", dim), ("post_ffw_norm", dim)):
            norm(f"{b}{n}.weight", size)
    norm("output_norm.weight", dim)
    return gguf.encode(meta, tensors)
