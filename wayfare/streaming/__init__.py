"""The trip questions asked of a live stream. Each agrees with its batch form once drained."""
