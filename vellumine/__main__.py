import sys

from vellumine.cli import main

sys.exit(main())
