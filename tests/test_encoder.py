import numpy as np
import pytest

from lodestone.functions.prompts import PromptError
from lodestone.operators import encoder as N
from lodestone.sources import gguf as G
from lodestone.streaming import ingest

DIM, HEADS, KV, INNER, LAYERS = 64, 4, 2, 96, 2
VOCAB = ["<unk>", "<s>", "</s>", "▁"] + list("abcdefghijklmnopqrstuvwxyz:|,")


def make(path, seed=3, **more):
    rng = np.random.default_rng(seed)
    p = "toy."
    meta = {"general.architecture": (8, "toy"), p + "embedding_length": (4, DIM), p + "block_count": (4, LAYERS), p + "attention.head_count": (4, HEADS), p + "attention.head_count_kv": (4, KV), p + "feed_forward_length": (4, INNER), p + "context_length": (4, 64), p + "attention.layer_norm_rms_epsilon": (6, 1e-5)}
    meta |= {"tokenizer.ggml.tokens": (9, (8, VOCAB)), "tokenizer.ggml.scores": (9, (6, [0.0] * len(VOCAB))), "tokenizer.ggml.token_type": (9, (5, [2, 3, 3] + [1] * (len(VOCAB) - 3))), "tokenizer.ggml.bos_token_id": (4, 1), "tokenizer.ggml.unknown_token_id": (4, 0)}
    meta |= more
    tensors, plain = {}, {}

    def q8(name, out, width):
        w = rng.standard_normal((out, width)).astype(np.float32) * 0.2
        raw = G.quantize_q8(w)
        tensors[name], plain[name] = (8, (width, out), raw), G.dequantize_q8(raw, w.size).reshape(w.shape)

    def f32(name, n):
        w = (1 + 0.1 * rng.standard_normal(n)).astype("<f4")
        tensors[name], plain[name] = (0, (n,), w.tobytes()), w

    q8("token_embd.weight", len(VOCAB), DIM)
    head = DIM // HEADS
    for i in range(LAYERS):
        b = f"blk.{i}."
        for n, out, width in (("attn_q", DIM, DIM), ("attn_k", KV * head, DIM), ("attn_v", KV * head, DIM), ("attn_output", DIM, DIM), ("ffn_gate", INNER, DIM), ("ffn_up", INNER, DIM), ("ffn_down", DIM, INNER)):
            q8(f"{b}{n}.weight", out, width)
        for n, size in (("attn_norm", DIM), ("ffn_norm", DIM), ("attn_q_norm", head), ("attn_k_norm", head), ("post_attention_norm", DIM), ("post_ffw_norm", DIM)):
            f32(f"{b}{n}.weight", size)
    f32("output_norm.weight", DIM)
    G.write(str(path), meta, tensors)
    return plain


def reference(w, ids):
    """The encoder in double precision, loop by loop, without rounding activations."""
    norm = lambda x, g: x / np.sqrt((x * x).mean() + 1e-5) * g
    head = DIM // HEADS
    x = [w["token_embd.weight"][i].astype(float) * np.sqrt(DIM) for i in ids]
    for i in range(LAYERS):
        g = lambda n: w[f"blk.{i}.{n}.weight"].astype(float)  # noqa: B023, E731

        def turn(v, pos):
            out = v.copy()
            for j in range(head // 2):
                a = pos / 10000 ** (2 * j / head)
                out[j], out[j + head // 2] = v[j] * np.cos(a) - v[j + head // 2] * np.sin(a), v[j] * np.sin(a) + v[j + head // 2] * np.cos(a)
            return out

        y = [norm(v, g("attn_norm")) for v in x]
        q = [[turn(norm(h, g("attn_q_norm")), p) for h in (g("attn_q") @ v).reshape(HEADS, head)] for p, v in enumerate(y)]
        k = [[turn(norm(h, g("attn_k_norm")), p) for h in (g("attn_k") @ v).reshape(KV, head)] for p, v in enumerate(y)]
        val = [(g("attn_v") @ v).reshape(KV, head) for v in y]
        for p in range(len(x)):
            mixed = []
            for h in range(HEADS):
                kv = h // (HEADS // KV)
                e = np.array([q[p][h] @ k[t][kv] / np.sqrt(head) for t in range(len(x))])
                e = np.exp(e - e.max())
                mixed.append(sum(a * val[t][kv] for t, a in enumerate(e / e.sum())))
            x[p] = x[p] + norm(g("attn_output") @ np.concatenate(mixed), g("post_attention_norm"))
        for p, v in enumerate(x):
            y2 = norm(v, g("ffn_norm"))
            gate = g("ffn_gate") @ y2
            x[p] = v + norm(g("ffn_down") @ (gate / (1 + np.exp(-1.702 * gate)) * (g("ffn_up") @ y2)), g("post_ffw_norm"))
    out = np.mean([norm(v, w["output_norm.weight"]) for v in x], axis=0)
    return out / np.linalg.norm(out)


@pytest.fixture(scope="module")
def toy(tmp_path_factory):
    path = tmp_path_factory.mktemp("model") / "toy.gguf"
    return str(path), make(path)


def test_forward_against_plain_loops(toy):
    path, w = toy
    e = N.encoder(path)
    ids = e.tokenizer.encode("hello world")
    got = e.forward(ids)
    assert np.linalg.norm(got) == pytest.approx(1, abs=1e-6)
    assert float(got @ reference(w, ids)) > 0.99
    short = e.forward(ids, 16)
    assert short == pytest.approx(got[:16] / np.linalg.norm(got[:16]), abs=1e-6)


def test_a_batch_has_the_vectors_of_single_texts(toy):
    e = N.encoder(toy[0])
    texts = ["abc", "hello world", "xyz", "a", "hello there", "b|c, d", "hello world"]
    ids = [e.tokenizer.encode(t) for t in texts]
    many = e.forward_many(ids, [None, 16, None, None, 32, None, None])
    for t, d, got in zip(ids, [None, 16, None, None, 32, None, None], many):
        assert got == pytest.approx(e.forward(t, d), abs=1e-6)
    got = e.embed_many([*texts, "q" * 99], [None] * 8, tokens=12)
    assert isinstance(got[-1], ValueError) and got[1] == pytest.approx(e.embed_text(texts[1]), abs=1e-6)
    kept = N.Encoder(G.open_file(toy[0]), keep=True)
    assert (kept.forward(ids[1]) == e.forward(ids[1])).all() and len(kept.kept) == 7 * LAYERS


def test_products_of_blocks():
    rng = np.random.default_rng(1)
    w = rng.standard_normal((5, 64)).astype(np.float32)
    raw = G.quantize_q8(w)
    x = rng.standard_normal((3, 64)).astype(np.float32)
    codes, scale = N.quantize_tensor(x)
    want = N.product(x, G.dequantize_q8(raw, w.size).reshape(w.shape))
    assert N.product_q8(codes, scale, G.q8_blocks(raw).reshape(5, 2)) == pytest.approx(want, rel=1e-5, abs=1e-5)
    own = N.product_rows(np.concatenate([x, 9 * x[:2]]), w, np.array([0, 3]), np.array([0, 0, 0, 1, 1]))
    assert own[:3] == pytest.approx(N.product(x, w)) and own[3:] == pytest.approx(N.product(9 * x[:2], w))


def test_errors(toy, tmp_path):
    e = N.encoder(toy[0])
    for bad in ([], [999], [-1], [4] * 65):
        with pytest.raises(ValueError):
            e.forward(bad)
    path = tmp_path / "no.gguf"
    G.write(str(path), {"general.architecture": (8, "toy")}, {})
    with pytest.raises(G.GGUFError):
        N.Encoder(G.open_file(str(path)))


def test_embed(spark, toy):
    rows = [(1, "SearchQuery", "abc", None, 0), (2, "SearchDocument", "abc", "t", 128), (3, "None", "  abc ", None, 256)]
    df = spark.createDataFrame(rows, "id int, task string, content string, title string, dim int")
    got = {r.id: r for r in N.embed(df, toy[0]).collect()}
    e = N.encoder(toy[0])
    assert got[3].vec == pytest.approx(e.embed_text("abc").tolist()) and got[1].error is None
    assert got[1].vec == pytest.approx(N.embed_one(toy[0], "abc").tolist())
    assert got[2].vec == pytest.approx(N.embed_one(toy[0], "abc", "SearchDocument", 128, "t").tolist())
    bad = df.union(spark.createDataFrame([(4, "SearchQuery", " ", None, 0), (5, "None", "a", None, 7), (6, "None", "a" * 99, None, 0)], df.schema))
    with pytest.raises(PromptError):
        N.embed(bad, toy[0])
    loose = {r.id: r for r in N.embed(bad, toy[0], strict=False).collect()}
    assert all(loose[i].vec is None and loose[i].error for i in (4, 5, 6)) and loose[1].vec == got[1].vec
    assert N.embed(df.limit(0), toy[0]).count() == 0


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 8)).astype(np.float32)
    codes, scale = N.quantize_tensor(x)
    assert np.abs(N.dequantize_tensor(codes, scale) - x).max() <= scale / 2 + 1e-6
    assert N.quantize_tensor(np.zeros((2, 2)))[1] == 1
    b, s = N.quantize_tensor(rng.standard_normal((5, 8)).astype(np.float32))
    assert N.product_int8(codes, scale, b, s) == pytest.approx(N.dequantize_tensor(codes, scale) @ N.dequantize_tensor(b, s).T, abs=1e-4)
    assert N.softmax(x).sum(axis=1) == pytest.approx([1, 1, 1])
    assert N.layer_norm(x, np.ones(8), np.zeros(8), 1e-6).mean(axis=1) == pytest.approx([0, 0, 0], abs=1e-6)
    assert N.rms_norm_shifted(x, np.zeros(8), 1e-6) == pytest.approx(N.rms_norm(x, np.ones(8), 1e-6))
    assert N.gelu(x) == pytest.approx(N.gelu_quick(x), abs=0.03) and N.relu(x).min() == 0
    assert N.silu(x) == pytest.approx(x / (1 + np.exp(-x)))
    assert (N.pool(x, "cls") == x[0]).all() and (N.pool(x, "max", 4) == x[:, :4].max(axis=0)).all()
    q = rng.standard_normal((4, 2, 8)).astype(np.float32)
    turned = N.rope(q, np.arange(4), 10000.0)
    assert np.linalg.norm(turned, axis=2) == pytest.approx(np.linalg.norm(q, axis=2), abs=1e-5) and (turned[0] == q[0]).all()


def test_model_files(spark, toy, tmp_path):
    path, plain = toy
    with open(path, "rb") as f:
        raw = f.read()
    for m in (G.open_bytes(raw), G.open_file(path)):
        assert m.metadata["general.architecture"] == "toy" and m.types["toy.block_count"] == "uint32"
        t = m.tensors["blk.0.attn_k.weight"]
        assert (t.dtype, t.shape, t.elements) == ("Q8_0", (64, 32), 2048) and t.size == 2048 // 32 * 34
        assert np.array_equal(m.floats(t.name), plain[t.name])
        assert m.view("output_norm.weight", "F32").shape == (64,)
        for bad in (lambda: m.view("output_norm.weight", "I8"), lambda: m.data("nothing")):  # noqa: B023
            with pytest.raises(G.GGUFError):
                bad()
    rows = {r.key: r for r in G.scan_metadata(spark, path).collect()}
    assert rows["toy.embedding_length"].value == "64" and rows["tokenizer.ggml.tokens"].type == "array"
    assert G.scan_tensors(spark, path).where("dtype = 'Q8_0'").count() == 1 + 7 * LAYERS
    data = G.scan_data(spark, path, "output_norm.weight").first().data
    assert np.array_equal(np.frombuffer(data, "<f4"), plain["output_norm.weight"])
    far = G.Model(G.Ranges("file://" + path))  # read by ranges, as a file that isn't local
    assert far.metadata == m.metadata and all(np.array_equal(far.data(n), m.data(n)) for n in m.tensors)
    assert np.array_equal(far.rows("token_embd.weight", 3, 4), plain["token_embd.weight"][3:7])
    assert np.array_equal(m.take("token_embd.weight", np.array([5, 0, 5])), plain["token_embd.weight"][[5, 0, 5]])
    rows = {r.row: r["values"] for r in G.scan_rows(spark, path, "blk.1.ffn_down.weight").collect()}
    assert np.array_equal(np.array([rows[i] for i in range(DIM)], np.float32), plain["blk.1.ffn_down.weight"])
    for bad in (raw[:20], b"XXXX" + raw[4:], raw[:4] + b"\2" + raw[5:], raw[:100]):
        with pytest.raises(G.GGUFError):
            G.open_bytes(bad)
    with pytest.raises(G.GGUFError):
        G.open_bytes(raw[:-8]).data("output_norm.weight")


def test_half_precision_subnormals():
    block = np.zeros(1, G.Q8_BLOCK)
    block["scale"] = np.float16(3.0517578e-05)
    block["codes"] = np.arange(32)
    assert G.dequantize_q8(block.tobytes(), 32)[2] == pytest.approx(2 * 3.0517578e-05)


def test_stream_appends(spark, tmp_path):
    from lodestone.operators import index as I

    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id bigint, vec array<float>")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        ingest.append_vectors(stream, str(tmp_path / "ix"), str(tmp_path / "cp"), "int8", 2).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "ix" / "vectors"))
    assert table.count() == 6
    loaded = I.load(spark, str(tmp_path / "ix"))
    assert (loaded.dim, loaded.mode, loaded.count()) == (2, "int8", 6) and I.search(loaded, rows.limit(1), 1).count() == 1
    more = spark.createDataFrame([(9, [1.0, 1.0])], rows.schema)
    ingest.append(more, 7, str(tmp_path / "ix"), "int8", 2)
    ingest.append(more, 7, str(tmp_path / "ix"), "int8", 2)  # a batch that runs again
    assert I.load(spark, str(tmp_path / "ix")).count() == 7
    with pytest.raises(I.VectorError):
        ingest.append(more, 8, str(tmp_path / "ix"), "int8", 2)


def test_attention_of_long_texts_by_parts(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(N, "LOGITS", 64)
    for size in (1, 6):  # logits that exponentials take as they are, and larger ones
        q, k, v = (size * rng.standard_normal((3, 21, h, 8)).astype(np.float32) for h in (4, 2, 2))
        want = np.stack([N.attention(*x, 8**-0.5) for x in zip(q, k, v)])
        np.testing.assert_allclose(N.attention_many(q, k, v, 8**-0.5), want, rtol=1e-3, atol=1e-3)


def test_texts_are_spread_over_many_tasks(spark, toy):
    path = toy[0] if isinstance(toy, tuple) else toy
    texts = spark.range(8).selectExpr("id", "'some words' AS text").repartition(spark.sparkContext.defaultParallelism)
    assert N.embed_texts(texts, str(path), dim=128, strict=False).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
