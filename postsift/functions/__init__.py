"""Column expressions: the cleaning chain, tokenizer/lexicon, time/count/link parsing."""
