"""Part of orbitlake."""
