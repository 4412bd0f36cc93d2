"""Inputs and outputs: driver tables, derived test inputs, file corpora, tool reports, config, sinks."""
