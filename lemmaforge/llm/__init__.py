"""Training-data operators: text in, decisions and artefacts out, at corpus scale."""
