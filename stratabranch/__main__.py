import sys

from stratabranch.cli import main

sys.exit(main())
