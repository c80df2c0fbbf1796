"""Part of meterwright; see the package README."""
