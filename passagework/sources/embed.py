"""Models of meaning: a contract, a stand-in, and embedding of passages in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Model(Protocol):
    """A model is picklable, loads its files in the worker, gives unit vectors, and gives a text the same vector alone
    and in a batch."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingModel:
    """Counts of the words by FNV-1a hash, of unit length; without words the first axis."""

    def __init__(self, dims: int = 64):
        self.name, self.dims = f"hashing@1 {dims}", dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                word = word.strip("".join(c for c in set(word) if not c.isalnum()))
                if not word:
                    continue
                h = 0xCBF29CE484222325
                for b in word.encode():
                    h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                out[i, h % self.dims] += 1
            if not out[i].any():
                out[i, 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def pool(tokens: np.ndarray, how: str) -> np.ndarray:
    """One vector of a matrix of token vectors: its first row (cls) or the mean."""
    return tokens[0] if how == "cls" else tokens.mean(axis=0)


class OnnxModel:
    """A sentence encoder from an ONNX file and a tokenizer file; both are loaded once in each worker."""

    def __init__(self, name: str, model: str, tokenizer: str, dims: int, max_tokens: int = 512, pooling: str = "cls", prefix: str = ""):
        self.name, self.model, self.tokenizer, self.dims = name, model, tokenizer, dims
        self.max_tokens, self.pooling, self.prefix, self._loaded = max_tokens, pooling, prefix, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        import onnxruntime
        from tokenizers import Tokenizer

        if self._loaded is None:
            tokenizer = Tokenizer.from_file(self.tokenizer)
            tokenizer.enable_truncation(self.max_tokens)
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._loaded = tokenizer, onnxruntime.InferenceSession(self.model, options)
        tokenizer, session = self._loaded
        out = []
        for text in texts:
            coded = tokenizer.encode(self.prefix + text)
            feeds = {"input_ids": [coded.ids], "attention_mask": [coded.attention_mask], "token_type_ids": [coded.type_ids]}
            feeds = {i.name: np.array(feeds[i.name], np.int64) for i in session.get_inputs()}
            v = pool(session.run(None, feeds)[0][0], self.pooling)
            out.append(v / (np.linalg.norm(v) or 1))
        return np.stack(out)


def embed(passages: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """key and embedding of each passage; only missing ones need be given, see operators.nearest.missing."""
    kinds = {f.name: f.dataType.simpleString() for f in passages.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[key].assign(embedding=list(model.embed([t or "" for t in batch["text"]])))

    return passages.select(*key, "text").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", embedding array<double>")
