"""Scalar column expressions; all stay in the JVM and in whole-stage codegen."""
