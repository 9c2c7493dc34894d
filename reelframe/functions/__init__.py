"""Part of reelframe; see the README."""
