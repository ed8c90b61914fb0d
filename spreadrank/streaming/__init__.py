"""No operator of this engine is a streaming one: all inputs are bounded."""
